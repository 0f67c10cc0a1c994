"""Each operator on odd and on empty tables: nothing crashes, every row is accounted for."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm import licenses, line_dedup, mixing, packing, quality, simhash_dedup, token_store, toxicity, url_filter, vafile

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    return t


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_every_operator_returns_every_row_of_odd_documents(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (6, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    want = ids(odd)
    assert ids(toxicity.toxicity(odd, labels)) == want
    assert ids(mixing.mix(odd)) == want
    assert ids(token_store.token_digest(odd, WORD_BPE)) == want
    assert ids(line_dedup.dedup_lines(odd)) == want
    assert ids(licenses.license_digest(odd)) == want
    assert ids(simhash_dedup.dedup_digest(odd)) == want
    assert ids(quality.judge(odd)) == want
    assert set(ids(packing.pack_digest(odd, BYTE_BPE))) == set(want)


def test_empty_tables_give_empty_results(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        toxicity.toxicity(empty, labels), mixing.mix(empty), mixing.mixed_documents(empty), token_store.token_digest(empty, WORD_BPE), line_dedup.dedup_lines(empty), licenses.license_digest(empty),
        simhash_dedup.dedup_digest(empty), simhash_dedup.keep_one(empty), quality.judge(empty), quality.keep(empty), packing.pack_digest(empty, BYTE_BPE),
        url_filter.judge(spark.createDataFrame([], "page_id long, url string")), vafile.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0),
    ):
        assert df.count() == 0


def test_token_store_round_trip(odd):
    tok = library(WORD_BPE)
    rows = token_store.token_digest(odd, WORD_BPE).collect()
    want = Counter((r["doc_id"], zlib.crc32(np.asarray([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in odd.collect())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    store = token_store.write_store(odd, WORD_BPE, "word", 2, block_ids=500)
    whole = {(r["doc_id"], r["start"]): r for r in token_store.read_store(store).collect()}
    some = token_store.fetch(store, [2, 7, 12, 999]).collect()
    assert Counter(r["doc_id"] for r in some) == {2: 2, 7: 1, 12: 2} and all(whole[r["doc_id"], r["start"]] == r for r in some)
    assert token_store.fetch(store, []).count() == 0
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("values,universe", [([], 0), ([0], 0), ([5], 5), ([0, 0, 3, 3, 9], 9), (list(range(2000)), 1999), ([10**9, 10**9 + 1], 10**9 + 1)])
def test_elias_fano_gives_its_values_back(values, universe):
    code = token_store.EliasFano(token_store.ef_encode(np.array(values, np.int64), universe))
    assert code.all().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values


def test_packing_tiles_every_document_without_padding(odd):
    tok = library(BYTE_BPE)
    rows = packing.pack(odd, BYTE_BPE, group_docs=4).collect()
    sequences, got = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        got[r["doc_id"]].append(r)
    for seq in sequences.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    docs = Counter((r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in odd.collect())
    for (d, want), n in docs.items():
        if n == 1 and sum(k[0] == d for k in docs) == 1:
            pieces = sorted(got[d], key=lambda r: r["start"])
            assert b"".join(bytes(p["ids"]) for p in pieces) == np.asarray(want, "<u4").tobytes()
    assert sum(r["length"] for r in rows) == sum(len(k[1]) * n for k, n in docs.items())


def test_nnls_reaches_the_minimum():
    r = np.random.RandomState(0)
    a = r.rand(12, 8)
    x = packing.nnls(a, a @ np.array([0, 1, 2, 0, 3, 0, 0, 1.0]), 3000)
    assert (x >= 0).all() and np.abs(a @ x - a @ np.array([0, 1, 2, 0, 3, 0, 0, 1.0])).max() < 1e-2


def test_mix_meets_targets_and_reruns_agree(odd, tables):
    for docs in (odd, tables("documents")):
        rows = mixing.mix(docs).collect()
        assert Counter(rows) == Counter(mixing.mix(docs.repartition(3)).collect())
        taken, target = defaultdict(int), {}
        sources = defaultdict(int)
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"]
        for s in {(r["source_size"], r["target"]) for r in rows}:
            target[s] = s[1]
        for r in rows:
            taken[r["source_size"], r["target"]] += r["taken"]
            sources[r["source_size"], r["target"]] += r["size"]
        for s, n in taken.items():
            groups = max(1, sources[s] // max(1, s[0]))
            assert abs(n - groups * target[s]) <= groups


def test_mix_is_laid_out_by_the_points(spark, tables, odd):
    docs = tables("documents")
    rows, p, slots = mixing.taken(docs)
    slots = slots.collect()
    assert Counter(r["s"] for r in slots) == Counter(dict(enumerate(p.slots)))
    phi = 2654435769
    edges = [sum(p.slots[: k + 1]) * 2**32 // p.length for k in range(len(p.slots))]
    by_points = {(r["slot"], r["s"]) for r in slots}
    hits = sum((i, next(k for k, e in enumerate(edges) if i * phi % 2**32 < e)) in by_points for i in range(p.length))
    assert hits >= 0.97 * p.length  # all but the ranks beyond a source's target
    for s in range(len(p.slots)):  # any prefix has the sources in proportion
        mine = sorted(r["slot"] for r in slots if r["s"] == s)
        assert all(abs(k - at * p.slots[s] / p.length) <= 4 for k, at in enumerate(mine))
    out = mixing.mixed(docs).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs).collect())
    assert len({r["slot"] for r in out}) > len(out) // 4 and max(r["slot"] for r in out) < p.length
    taken = Counter(r["doc_id"] for r in mixing.mixed(odd).collect())
    assert set(taken) <= {r["doc_id"] for r in odd.collect()}


def test_targets_share_the_excess_again():
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 10], [5, 2]) == [0.0, 10.0]
    assert mixing.targets([], []) == []


def test_toxicity_never_learns_held_out_rows(spark, tables):
    docs, labels = tables("documents"), tables("labels")
    texts, toxic = toxicity.training_rows(docs, labels, 50)
    assert 0 < len(texts) <= 100 and len(texts) == len(toxic)
    known = {r["text"] for r in docs.collect() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    assert set(texts) <= known
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(docs, labels).collect()) == sorted(toxicity.toxicity(docs, flipped).collect())


def test_toxicity_on_held_out_rows():
    """Held-out accuracy on a larger table."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.03 * len(rows)


def test_licenses_against_a_plain_reading(odd):
    import re

    word = re.compile(licenses.WORD)
    table = str.maketrans(licenses._UPPER, licenses._LOWER)

    def plain(text):
        w = word.findall((text or "").translate(table))
        at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in at]
        return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))

    spark = odd.sparkSession
    more = ["MIT License mit-license GNU General Public License v3 or later", "--cc--by--", "emit license cc byte", "Apache License, Version 2.0", "cc by cc by cc by-sa 4.0", "mit\nlicense gnu general public"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.license_digest(docs).collect())
    assert got == Counter((r["doc_id"], *plain(r["text"])) for r in docs.collect())


def test_license_rules_suppress_what_lies_within_a_stronger_one(spark):
    docs = spark.createDataFrame([(1, "Licensed under CC BY-NC-SA 4.0."), (2, "SPDX-License-Identifier: GPL-3.0-or-later"), (3, "under the Mozilla Public License, version 2.0"), (4, "nothing")], "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in licenses.license_digest(docs).collect()}
    assert labels == {1: "cc-by,cc-by-nc-sa-4.0", 2: "gpl-3.0-or-later", 3: "mpl-2.0", 4: ""}
    assert 200 < len(licenses.rules()) and len(set(licenses.rules())) == len(licenses.rules())


def test_url_rules_and_parts(spark):
    rows = [
        (1, None), (2, "foo"), (3, "http://A.NET/x?y#z"), (4, "http://x.example.NET/en/a"), (5, "http://net?x"), (6, "http://org/fr/"), (7, "ftp://Host:80//p?q"), (8, "x://a.example.com/de/1"), (9, "http://bexample.com/de/"),
        (10, "http://cheap-pills-77.example.com/en/1?a=1&b=2&c=3&d=4"), (11, "https://www.garden.example.org/en/12"),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1][:3] == ("", "", None) and got[2][:3] == ("", "", None)
    assert got[3] == ("a.net", "/x", "net/", "block") and got[4] == ("x.example.net", "/en/a", "example.net/en/", "allow")
    assert got[5][:3] == ("net", "", None) and got[6] == ("org", "/fr/", "org/fr/", "allow")
    assert got[7][:3] == ("host:80", "//p", None) and got[8][2:] == ("example.com/de/", "block") and got[9][2] is None
    assert got[10][3] == "block" and got[11][3] == "allow"


def test_simhash_components_against_all_pairs(odd):
    rows = odd.select("doc_id", "text").collect()

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((r["doc_id"] for r, x in zip(rows, group) if x == g and r["doc_id"] is not None), default=None) for g in group}
    want = Counter((r["doc_id"], format(f, "016x"), least[g]) for r, f, g in zip(rows, fps, group))
    assert Counter(tuple(r) for r in simhash_dedup.dedup_digest(odd).collect()) == want


def test_shard_trees_lose_no_link_in_hot_shards(spark):
    r = np.random.RandomState(2)
    values = np.unique(r.randint(0, 1 << 12, 1500))
    classes = spark.createDataFrame([(int(v), int(v), 0) for v in values], "id long, fp long, fp2 long")
    links = [tuple(x) for x in simhash_dedup.link_classes(classes, len(values), 2, tree_cap=32).collect()]
    parent = {int(v): int(v) for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    for i, a in enumerate(values.tolist()):
        for b in values[:i][np.bitwise_count(values[:i] ^ a) <= 2].tolist():
            assert root(a) == root(b)


def test_vector_search_cases(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [None, 1.0]), (40, None), (1, [float("nan")]), (2, [1e300, -1e300]), (3, []), (None, [1.0]), (4, [3.0, 1.0, 5.0]), (5, [3.0, 1.0])]
    got = [tuple(r) for r in vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=2).collect()]
    assert sorted(got) == [(0, 1, 4, 20480), (0, 1, 4, 20480), (0, 2, 5, 20480), (0, 2, 5, 20480)]


@pytest.mark.parametrize("block,scale", [(16384, 64.0), (7, 3000.0)])
def test_vector_search_against_brute_force(tables, block, scale):
    df = tables("embeddings")
    rows = {r["vec_id"]: np.floor(scale * np.array(r["embedding"], np.float64)).astype(int) for r in df.collect()}
    got = defaultdict(list)
    for r in vafile.top_k(df, F.col("vec_id") % 20 == 0, query_block=block, scale=scale).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, v in rows.items():
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in rows.items() if i != q)[:20]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_quality_base_metrics_against_a_plain_reading(odd):
    import re

    rows = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(odd).collect()}
    for r in odd.collect():
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        assert (r["doc_id"], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed) in rows


def test_quality_keeps_clean_documents_and_drops_junk():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs).join(labels, "doc_id").collect()
    clean = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    assert sum(r["kept"] for r in junk) <= 0.2 * len(junk)


def test_lines_keep_one_of_each_group(spark):
    line = "the quick brown fox jumps over the lazy dog near the old stone bridge today"
    rows = [(1, f"{line}\nshort line\n{line}!"), (2, f"intro words that stand here alone\n{line.upper()}"), (2, None), (3, "short line\nshort line"), (4, line.replace("today", "todays")), (5, line), (5, line), (None, line)]
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    kept = [t for _, t, _ in got if t and "fox" in t.lower()]
    assert len(kept) <= 2 and (0, line, 0) in got  # the null doc_id sorts first and keeps the line
    assert (1, "short line", 2) in got and (3, "short line\nshort line", 0) in got and (2, None, 0) in got
    assert (2, "intro words that stand here alone", 1) in got


@pytest.mark.parametrize("radius", [2, 5])
def test_every_pair_within_the_radius_shares_a_choice_of_blocks(radius):
    from lexiloom.llm.bits import masks, scheme

    r = np.random.RandomState(4)
    for n in (10, 10**6, 10**9, 10**12):
        choices = masks(*scheme(n, radius))
        for _ in range(50):
            a = int(r.randint(0, 1 << 62))
            b = a
            for bit in r.choice(64, radius, replace=False):
                b ^= 1 << int(bit)
            assert any((a ^ b) & m == 0 for m in choices)


def test_near_copies_are_found_and_others_left_alone(spark):
    r = np.random.RandomState(6)
    vocabulary = ["".join(r.choice(list("abcdefghij"), 5)) for _ in range(400)]
    rows = []
    for k in range(60):
        words = [vocabulary[i] for i in r.randint(0, 400, 200)]
        rows.append((10 * k, " ".join(words)))
        if k % 3 == 0:
            for at in r.choice(200, 3, replace=False):
                words[at] = vocabulary[r.randint(400)]
            rows.append((10 * k + 1, " ".join(words).capitalize() + "!"))
    got = {x["doc_id"]: x["component_id"] for x in simhash_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[10 * k + 1] == 10 * k for k in range(0, 60, 3)) >= 19
    assert all(got[10 * k] == 10 * k for k in range(60))
