"""License scan: ordered signature rules over word sequences, in DataFrame functions only.

A text's words are its runs of [0-9a-z] and non-ASCII characters after A-Z are
lower-cased; rules are regular expressions over the words joined by single
spaces.  Rules are grouped by keyword: a text is looked at only if it passes a
prefilter, and a group's rules only if a word of the text starts with the group's
keyword, which every name has of its own ("gpl" and "general public").
Every rule has a priority; a detection whose words lie within those of a
detection with higher priority is suppressed ("apache license" within
"licensed under the apache license version 2 0"), as is one within a longer
detection, or one of a smaller label in the same words, of equal priority.
Rules name texts and headers of licences, and families by version and way of
naming; "+" is no word, so "GPLv2+" is read as "GPLv2".

The base phrases (four, with the labels of the contract) are counted at every
place; their labels are never suppressed.

Scale: one pass, row by row, no shuffle and no Python; texts that fail the
prefilter cost a word count and one search.

Cases: a null or empty text has no words and no labels ('' and score 0);
repeated rows are scanned each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    key: str  # starts a word of every text that the regex fits
    regex: str  # over words joined by single spaces
    priority: int
    label: str


# label, names by a keyword that starts a word of each (regular expressions over words), versions
_FAMILIES = [
    ("gpl", {"general public": "gnu general public licen[cs]e", "gpl": "gnu gpl|gpl"}, "1.0 2.0 3.0"),
    ("lgpl", {"lesser general public": "gnu lesser general public licen[cs]e", "lgpl": "gnu lgpl|lgpl"}, "2.0 2.1 3.0"),
    ("agpl", {"affero": "gnu affero general public licen[cs]e", "agpl": "gnu agpl|agpl"}, "1.0 3.0"),
    ("gfdl", {"free documentation": "gnu free documentation licen[cs]e", "gfdl": "gfdl"}, "1.1 1.2 1.3"),
    ("apache", {"apache": "apache software licen[cs]e|apache licen[cs]e|apache"}, "1.0 1.1 2.0"),
    ("mit", {"mit licen": "mit licen[cs]e", "expat licen": "expat licen[cs]e"}, ""),
    ("bsd", {"bsd": "bsd licen[cs]e", "berkeley software": "berkeley software distribution"}, ""),
    ("mpl", {"mozilla public": "mozilla public licen[cs]e", "mpl": "mpl"}, "1.0 1.1 2.0"),
    ("epl", {"eclipse public": "eclipse public licen[cs]e", "epl": "epl"}, "1.0 2.0"),
    ("eupl", {"european union public": "european union public licen[cs]e", "eupl": "eupl"}, "1.0 1.1 1.2"),
    ("cddl", {"common development": "common development and distribution licen[cs]e", "cddl": "cddl"}, "1.0 1.1"),
    ("cpl", {"common public licen": "common public licen[cs]e", "cpl": "cpl"}, "1.0"),
    ("artistic", {"artistic licen": "artistic licen[cs]e"}, "1.0 2.0"),
    ("bsl", {"boost software": "boost software licen[cs]e", "bsl": "bsl"}, "1.0"),
    ("zlib", {"zlib": "zlib licen[cs]e"}, ""),
    ("isc", {"isc licen": "isc licen[cs]e"}, ""),
    ("ofl", {"open font": "sil open font licen[cs]e|open font licen[cs]e", "ofl": "ofl"}, "1.0 1.1"),
    ("odbl", {"open database": "open database licen[cs]e", "odbl": "odbl"}, "1.0"),
    ("osl", {"open software licen": "open software licen[cs]e", "osl": "osl"}, "1.0 2.0 2.1 3.0"),
    ("afl", {"academic free": "academic free licen[cs]e", "afl": "afl"}, "1.1 1.2 2.0 2.1 3.0"),
    ("wtfpl", {"do what the": "do what the (?:fuck|f) you want to public licen[cs]e", "wtfpl": "wtfpl"}, "2.0"),
    ("unlicense", {"unlicense": "the unlicense|unlicense"}, ""),
    ("psf", {"python software": "python software foundation licen[cs]e", "psf licen": "psf licen[cs]e"}, "2.0"),
    ("php", {"php licen": "php licen[cs]e"}, "3.0 3.01"),
    ("ms-pl", {"microsoft public": "microsoft public licen[cs]e"}, ""),
    ("lppl", {"latex project": "latex project public licen[cs]e", "lppl": "lppl"}, "1.0 1.2 1.3"),
    ("cc0", {"cc0": "cc0", "creative commons zero": "creative commons zero"}, "1.0"),
    ("public-domain", {"public domain": "public domain dedication|(?:released|dedicated|placed) (?:in|into|to) the public domain"}, ""),
]
# the Creative Commons licences are parts x versions
_CC_PARTS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?", "nc": "non ?commercial"}


def _version(v: str) -> str:
    """2.0 as words: 2 0, and 2 alone."""
    major, minor = v.split(".")
    return rf"v?{major}(?: {minor})" + ("?" if minor == "0" else "")


# What the texts and file headers of licences say, in their own words; keyword, words, priority, label.
_TEXTS = [
    ("permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 2, "mit"),
    ("permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 3, "mit"),
    ("above copyright notice and this permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 3, "mit"),
    ("permission is hereby", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation", 3, "bsl-1.0"),
    ("permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 2, "isc"),
    ("permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 3, "isc"),
    ("permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 4, "0bsd"),
    ("redistribution and use", "redistribution and use in source and binary forms with or without modification", 2, "bsd"),
    ("redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 3, "bsd"),
    ("redistributions of source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 3, "bsd"),
    ("redistributions in binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 3, "bsd"),
    ("nor the name", "nor the names? of (?:its|any other|the) contributors may be used to endorse or promote products derived from this software", 4, "bsd-3-clause"),
    ("all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 4, "bsd-4-clause"),
    ("governed by a bsd", "governed by a bsd style licen[cs]e", 2, "bsd"),
    ("apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 6, "apache-2.0"),
    ("you may not use this file", "you may not use this file except in compliance with the license", 3, "apache-2.0"),
    ("unless required by applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 4, "apache-2.0"),
    ("apache license", "apache license version 2 0 january 2004", 5, "apache-2.0"),
    ("apache org", "apache org licenses license 2 0", 4, "apache-2.0"),
    ("source code form", "this source code form is subject to the terms of the mozilla public license v 2 0", 6, "mpl-2.0"),
    ("mpl was not", "if a copy of the mpl was not distributed with this file you can obtain one at", 4, "mpl-2.0"),
    ("mozilla org mpl", "mozilla org mpl 2 0", 4, "mpl-2.0"),
    ("contents of this file", "the contents of this file are subject to the mozilla public license version 1 1", 6, "mpl-1.1"),
    ("contents of this file", "the contents of this file are subject to the terms of the common development and distribution license", 4, "cddl"),
    ("accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0", 6, "epl-2.0"),
    ("accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0", 6, "epl-1.0"),
    ("this font software", "this font software is licensed under the sil open font license version 1 1", 6, "ofl-1.1"),
    ("free and unencumbered", "this is free and unencumbered software released into the public domain", 4, "unlicense"),
    ("everyone is permitted", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 4, "wtfpl"),
    ("everyone is permitted", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 2, "gpl"),
    ("free software foundation", "gnu general public license as published by the free software foundation", 2, "gpl"),
    ("free software foundation", "gnu lesser general public license as published by the free software foundation", 3, "lgpl"),
    ("free software foundation", "gnu affero general public license as published by the free software foundation", 3, "agpl"),
    ("you should have received", "you should have received a copy of the gnu general public license along with this (?:program|software|library|file)", 3, "gpl"),
    ("you should have received", "you should have received a copy of the gnu lesser general public license along with this (?:program|software|library|file)", 3, "lgpl"),
    ("you should have received", "you should have received a copy of the gnu affero general public license along with this (?:program|software|library|file)", 3, "agpl"),
    ("gnu org licenses", "gnu org licenses gpl(?: 3 0)?", 2, "gpl"),
    ("gnu org licenses", "gnu org licenses lgpl(?: 3 0)?", 2, "lgpl"),
    ("gnu org licenses", "gnu org licenses agpl(?: 3 0)?", 2, "agpl"),
    ("origin of this software", "the origin of this software must not be misrepresented", 3, "zlib"),
    ("in no event will the authors", "in no event will the authors be held liable for any damages arising from the use of this software", 2, "zlib"),
    ("waived all copyright", "has waived all copyright and related or neighbou?ring rights", 3, "cc0"),
    ("attribution assurance", "attribution assurance licen[cs]e", 1, "aal"),
    ("opensource org licenses", "opensource org licenses mit(?: license)?", 3, "mit"),
    ("opensource org licenses", "opensource org licenses apache 2 0", 4, "apache-2.0"),
    ("opensource org licenses", "opensource org licenses bsd license", 3, "bsd"),
    ("all rights reserved", "all rights reserved", 1, "proprietary"),
    ("confidential and proprietary", "confidential and proprietary", 1, "proprietary"),
    ("proprietary and confidential", "proprietary and confidential", 1, "proprietary"),
]


def _later(n: str) -> list[str]:
    """Words after a name that allow version ``n`` or later: "version 2 or later", and the notice's
    "either version 2 of the License, or (at your option) any later version"."""
    number = rf"(?:licen[cs]e )?(?:version |v )?{n}"
    return [
        f"{number} or (?:any |at your option any |at your option )?later(?: version)?",
        f"(?:as published by the free software foundation )?(?:either )?version {n} of the licen[cs]e or (?:at your option )?any later version",
    ]


def rules() -> list[Rule]:
    """Hundreds of signatures: texts and headers of licences, and the products of families, versions and ways of naming."""
    out = [Rule(*x) for x in _TEXTS]
    for label, names, versions in _FAMILIES:
        for key, some in names.items():
            out.append(Rule(key, f"(?:{some})", 1, label))
            out.append(Rule(key, f"(?:licen[cs]ed|released|distributed|available|provided) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:{some})", 2, label))
        out.append(Rule("spdx", f"spdx licen[cs]e identifier {label.replace('-', ' ')}(?: only)?", 4, label))
        for v in versions.split():
            full, number = f"{label}-{v}", rf"(?:licen[cs]e )?(?:version |v )?{_version(v)}"
            for key, some in names.items():
                out.append(Rule(key, f"(?:{some}) {number}", 3, full))
                out += [Rule(key, f"(?:the )?(?:{some}) {later}", 5, f"{full}-or-later") for later in _later(_version(v))]
                out.append(Rule(key, f"(?:{some}) (?:as published by the free software foundation )?(?:either )?version {_version(v)} of the licen[cs]e", 4, full))
            out.append(Rule(label, rf"{label} {_version(v)}", 2, full))
            out.append(Rule(f"{label}v", rf"{label}{_version(v).replace('v?', 'v')}", 3, full))
            out.append(Rule(f"{label}v", rf"{label}{_version(v).replace('v?', 'v')} or (?:any )?later(?: version)?", 5, f"{full}-or-later"))
            out.append(Rule("spdx", f"spdx licen[cs]e identifier {label} {_version(v)}(?: only)?", 5, full))
            out.append(Rule("spdx", f"spdx licen[cs]e identifier {label} {_version(v)} or later", 6, f"{full}-or-later"))
    for parts in _CC_PARTS:
        short, long = parts.replace("-", " "), " ".join(_CC_WORDS[p] for p in parts.split("-"))
        # more parts outrank fewer: "cc by nc" lies in front of "cc by"
        more = parts.count("-")
        out.append(Rule("cc ", f"cc {short}", 1 + more, f"cc-{parts}"))
        out.append(Rule("creative commons", f"creative commons {long}(?: international| unported| generic)?(?: (?:public )?licen[cs]e)?", 1 + more, f"cc-{parts}"))
        for v in _CC_VERSIONS:
            out.append(Rule("cc ", f"cc {short} {_version(v)}", 4 + more, f"cc-{parts}-{v}"))
            out.append(Rule("creative commons", f"creative commons {long} {_version(v)}(?: international| unported| generic)?(?: (?:public )?licen[cs]e)?", 4 + more, f"cc-{parts}-{v}"))
            out.append(Rule("creativecommons", f"creativecommons org licenses {short} {_version(v)}", 4 + more, f"cc-{parts}-{v}"))
    for n in (2, 3, 4):
        out.append(Rule("bsd", rf"(?:{n} clause bsd|bsd {n} clause)(?: licen[cs]e)?", 3, f"bsd-{n}-clause"))
    return list(dict.fromkeys(out))


_MOST_PRIORITY = 7


def _quote(s: str) -> str:
    return "r'" + s.replace("'", "''") + "'"


def _blocks(array: str) -> str:
    """SQL: an array in blocks of 512, so that what is appended to stays short in texts of very many places."""
    return f"transform(array({array}), z -> transform(sequence(1, greatest(size(z), 1), 512), k -> slice(z, k, 512)))[0]"


def _starts(regex: str) -> str:
    """SQL: the first words of the places of a regular expression (as SQL) in ``padded``, and in front of
    them 0 where the text does not start with one: how many words each part of the text, cut at every place, has before it."""
    spaces = f"transform(split(padded, concat('(?= ', {regex}, ' )')), p -> CAST(length(p) - length(replace(p, ' ', '')) AS BIGINT))"
    return f"""aggregate({_blocks(spaces)}, named_struct('at', CAST(array() AS ARRAY<ARRAY<BIGINT>>), 'n', CAST(0 AS BIGINT)),
        (a, b) -> transform(array(aggregate(b, named_struct('at', CAST(array() AS ARRAY<BIGINT>), 'n', a.n), (x, c) -> named_struct('at', array_append(x.at, x.n), 'n', x.n + c))),
            y -> named_struct('at', array_append(a.at, y.at), 'n', y.n))[0], a -> flatten(a.at))"""


def _places(regex: str) -> str:
    """SQL: the first words of the places of a regular expression (as SQL) in ``padded``."""
    return f"transform(array({_starts(regex)}), at -> if(regexp_like(padded, concat('^ ', {regex}, ' ')), at, slice(at, 2, size(at))))[0]"


def _detections(group: list[Rule]) -> str:
    """SQL: all detections of the rules of one keyword; null where the keyword or every rule is absent from ``padded``.

    Matches are taken from within a lookahead, so that they may overlap."""
    listed = ", ".join(f"named_struct('regex', {_quote(r.regex)}, 'priority', {r.priority}, 'label', {_quote(r.label)})" for r in group)
    matches = "regexp_extract_all(padded, concat('(?=( ', r.regex, ') )'), 1)"
    one = f"""zip_with({_places('r.regex')}, {matches}, (f, m) -> named_struct('first', f, 'last', f + length(m) - length(replace(m, ' ', '')) - 1, 'priority', r.priority, 'label', r.label))"""
    every = _quote(" (?:" + "|".join(dict.fromkeys(r.regex for r in group)) + ") ")
    return f"CASE WHEN contains(padded, {_quote(' ' + group[0].key)}) AND regexp_like(padded, {every}) THEN flatten(transform(filter(array({listed}), r -> regexp_like(padded, concat(' ', r.regex, ' '))), r -> {one})) END"


def _suppressed(column: str, kind: str) -> str:
    """SQL: the detections not within one of higher priority, of equal priority and more words, or of the same
    words, equal priority and a smaller label.  In order of first word (then of more words, higher
    priority, label) what contains a detection comes before it, so each is held against those still open."""
    order = "CASE WHEN l.first <> r.first THEN CAST(sign(l.first - r.first) AS INT) WHEN l.last <> r.last THEN CAST(sign(r.last - l.last) AS INT) WHEN l.priority <> r.priority THEN r.priority - l.priority WHEN l.label < r.label THEN -1 WHEN l.label > r.label THEN 1 ELSE 0 END"
    beats = "e.last >= d.last AND (e.priority > d.priority OR (e.priority = d.priority AND (e.first < d.first OR e.last > d.last OR e.label <= d.label)))"
    step = f"(x, d) -> named_struct('kept', if(exists(x.open, e -> {beats}), x.kept, array_append(x.kept, d)), 'open', array_append(filter(x.open, e -> e.last >= d.first), d))"
    return f"""aggregate({_blocks(f'array_sort({column}, (l, r) -> {order})')}, named_struct('kept', CAST(array() AS ARRAY<{kind}>), 'open', CAST(array() AS {kind})),
        (a, b) -> transform(array(aggregate(b, named_struct('kept', CAST(array() AS {kind}), 'open', a.open), {step})), y -> named_struct('kept', array_append(a.kept, y.kept), 'open', y.open))[0], a -> flatten(a.kept))"""


def prefilter(keys: list[str]) -> str:
    """A regular expression for any of the keywords at the start of a word, grouped by first letter."""
    by: dict[str, set[str]] = {}
    for k in keys:
        by.setdefault(k[0], set()).add(k[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(by.items())) + ")"


def scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections: the method's surviving detections (first, last word, priority, label)."""
    signatures = rules() if signatures is None else signatures
    keys = sorted({r.key for r in signatures})
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim(F.regexp_replace(low, SEPARATOR, " ")).alias("words"))
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), F.concat(F.lit(" "), "words", F.lit(" ")).alias("words"))
    rows = rows.select("doc_id", "n_words", F.when(F.col("words").rlike(prefilter([*keys, *BASE])), F.col("words")).alias("padded"))
    base = "array(" + ", ".join(f"named_struct('label', {_quote(label)}, 'at', {_places(_quote(phrase))})" for phrase, label in BASE.items()) + ")"
    rows = rows.withColumn("base", F.expr(f"CASE WHEN padded IS NOT NULL THEN {base} END"))
    kind = "ARRAY<STRUCT<first: BIGINT, last: BIGINT, priority: INT, label: STRING>>"
    found = ", ".join(_detections([r for r in signatures if r.key == k]) for k in keys)
    rows = rows.withColumn("all", F.expr(f"CASE WHEN padded IS NOT NULL THEN flatten(filter(array(CAST(array() AS {kind}){', ' * bool(keys)}{found}), g -> g IS NOT NULL)) END"))
    rows = rows.withColumn("detections", F.expr(f"coalesce({_suppressed('all', kind)}, CAST(array() AS {kind}))"))
    starts = F.expr("coalesce(flatten(transform(base, b -> b.at)), array())")
    mine = F.expr("coalesce(transform(filter(base, b -> size(b.at) > 0), b -> b.label), array())")
    comma = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0))
    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        comma(mine).alias("base_labels"), comma(F.concat(mine, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.greatest(F.when(F.size(starts) > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.least(F.lit(1.0), (best + 3) / F.lit(_MOST_PRIORITY + 3)) * (best > 0).cast("double")).alias("score"), "detections",
    )


def license_digest(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("detections")


