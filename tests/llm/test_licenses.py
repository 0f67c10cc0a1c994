from itertools import product
from re import _parser as parser

from lexiloom.llm import licenses


def every(tree):
    """All strings that a regular expression without unbounded repeats fits."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            new = [chr(arg)]
        elif name == "IN":
            new = [chr(x) for _, x in arg]
        elif name == "BRANCH":
            new = [x for branch in arg[1] for x in every(branch)]
        elif name == "SUBPATTERN":
            new = every(arg[3])
        else:
            assert name == "MAX_REPEAT" and arg[:2] == (0, 1)
            new = ["", *every(arg[2])]
        out = [a + b for a, b in product(out, new)]
    return out


def test_every_rule_has_a_keyword_that_starts_a_word_of_all_its_matches():
    for r in licenses.rules():
        assert all(f" {r.key}" in f" {x} " for x in every(parser.parse(r.regex))), r


def test_short_names_are_found_without_the_long_ones(spark):
    want = {
        "released under the GNU GPL version 3 or later": "gpl-3.0-or-later", "licensed under the LGPL 2.1": "lgpl-2.1", "the AGPL v3": "agpl-3.0", "MPL 2.0": "mpl-2.0", "Expat license": "mit",
        "see the EUPL": "eupl", "CDDL 1.1": "cddl-1.1", "WTFPL": "wtfpl", "a Berkeley Software Distribution": "bsd", "Creative Commons Zero 1.0": "cc0-1.0", "PSF license 2": "psf-2.0", "we deploy and replace it": "",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.license_digest(docs).collect()}
    assert all(label in got[k] for k, label in enumerate(want.values()))


def plain(text, signatures):
    """Labels by a scan with every rule at every word, without keywords."""
    import re

    words = re.findall(licenses.WORD, (text or "").translate(str.maketrans(licenses._UPPER, licenses._LOWER)))
    padded, at, n = " " + " ".join(words) + " ", {}, 0
    for i, c in enumerate(padded):
        if c == " ":
            at[i] = n
            n += 1
    found = set()
    for r in signatures:
        regex = re.compile(f" {r.regex}(?= )")
        for i, first in at.items():
            m = regex.match(padded, i)
            if m:
                found.add((first, first + m.group().count(" ") - 1, r.priority, r.label))
    within = lambda d, e: e[0] <= d[0] and e[1] >= d[1]
    beats = lambda e, d: e[2] > d[2] or (e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3]))
    return {d for d in found if not any(e != d and within(d, e) and beats(e, d) for e in found)}


NOTICES = [
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software",
    "GPLv3, LGPLv2.1 or later; cc by cc by cc by-sa 4.0 cc by", "mit license mit license mit-license. MIT", "apache license apache apache license version 2.0 or later", "a " * 3000 + "isc license " + "b " * 50, "GPL " * 400 + "GPL 2.0", "",
]


def test_labels_and_detections_against_a_scan_without_keywords(spark, tables):
    few = [r["text"] for r in tables("documents").collect() if "licen" in (r["text"] or "").lower()][:12]
    docs = spark.createDataFrame(list(enumerate(NOTICES + few)), "doc_id long, text string")
    signatures = licenses.rules()
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for k, text in enumerate(NOTICES + few):
        want = plain(text, signatures)
        assert {tuple(d) for d in got[k]["detections"]} == want, text[:60]
        base = [x for x in got[k]["base_labels"].split(",") if x]
        assert got[k]["labels"] == ",".join(sorted({*base, *(d[3] for d in want)}))
    labels = [got[k]["labels"].split(",") for k in range(5)]
    assert "gpl-2.0-or-later" in labels[0] and "apache-2.0" in labels[1] and "mpl-2.0" in labels[2] and "bsd-3-clause" in labels[3] and {"gpl-3.0", "lgpl-2.1-or-later", "cc-by-sa-4.0"} <= set(labels[4])


def test_a_long_text_with_very_many_detections(spark):
    docs = spark.createDataFrame([(1, "see the MIT License or GPL 2.0, " * 20_000)], "doc_id long, text string")
    row = licenses.scan(docs).first()
    assert row["n_base"] == 20_000 and len(row["detections"]) == 40_000
