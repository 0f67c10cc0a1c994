"""Properties and edge cases of operators that the table queries do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom import config, streaming
from lexiloom.operators import chunking, citations, graph, ranking, search
from lexiloom.sources import stores


def test_mmr_closed_form_equals_the_greedy_loop(spark):
    r = random.Random(3)
    for _ in range(5):
        rows = [(i, round(r.random(), 2), r.randrange(4)) for i in range(12)]
        for lam in (0.0, 0.7, 1.0):
            left, picked = sorted(rows, key=lambda x: (-x[1], x[0])), []
            while left and len(picked) < 6:
                keys = {x[2] for x in picked}
                best = max(left, key=lambda x: (round(x[1] if lam >= 1 else lam * x[1] - (1 - lam) * (x[2] in keys), 12), x[1], -x[0]))
                picked.append(best)
                left.remove(best)
            df = spark.createDataFrame(rows, "id long, score double, key int")
            got = [x["id"] for x in ranking.diverse(df, 6, ["key"], lam).collect()]
            if lam > 0:
                assert got == [x[0] for x in picked]


def test_token_budget_keeps_the_rest_under_the_cap(spark):
    r = random.Random(5)
    kinds = list(ranking.TIERS)
    rows = [(i, r.random(), [r.choice(kinds)], r.randrange(1, 50)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, score double, sources array<string>, tokens long")
    for most in (0, 100, 10_000):
        out = ranking.token_budget(df, most, reserve=2).collect()
        assert sum(x["tokens"] for x in out if not x["trimmed"] and not x["reserved"]) <= most
        assert sum(x["reserved"] for x in out) <= 2
        if most == 10_000:
            assert not any(x["trimmed"] for x in out)


def test_empty_query_finds_nothing(spark, tables):
    chunks = tables("documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("agency"))
    assert search.bm25_topk(chunks, "").count() == 0
    assert search.bm25_topk(chunks, "zzzzzz").count() == 0


def test_unknown_agencies_mean_no_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, agency string")
    assert search.agency_filter(df, ["nowhere"], ["a", "b"]).count() == 2
    assert search.agency_filter(df, ["a", "nowhere"], ["a", "b"]).count() == 1


def test_zero_and_missing_vectors_take_no_part(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], "x"), (2, None, "x"), (3, [1.0, 0.0], "x")], "id long, vector array<double>, agency string")
    assert [r["id"] for r in search.vector_topk(v, [1.0, 1.0]).collect()] == [3]
    assert search.batch_knn(v, v, 3).count() == 0


def test_opposite_vectors_have_no_mean_direction(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "id long, vector array<double>")
    leaves = spark.createDataFrame([(0, 1, 1), (1, 1, 2)], "leaf int, rank int, id long")
    seeds, mean = graph.fuse_seeds(leaves, v)
    assert seeds.count() == 2 and mean.first()["vector"] is None


def test_session_gap_of_exactly_the_limit_stays_together(spark):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 01:00:00"), (3, 1, "2024-01-01 02:00:00.000001"), (4, 2, "2024-01-01 00:59:59")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r["event_id"], r["session"]) for r in streaming.with_session(df).collect()) == [(1, 1), (2, 1), (3, 2), (4, 1)]
    assert sorted(r["n"] for r in streaming.sessions(df).where("user_id = 1").collect()) == [1, 2]


def test_stream_sessions_equal_batch_sessions(spark, tables, tmp_path):
    events = tables("events")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.stream_sessions(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["user_id"], r["start"]) for r in spark.table("closed").collect()}
    batch = streaming.sessions(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got <= {(r["user_id"], r["start"]) for r in batch.collect()} and got


def test_stateful_sessions_count_every_event(spark, tables, tmp_path):
    pytest.importorskip("pandas")
    events = tables("events").select("user_id", "ts", "event_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.stateful_sessions(stream).writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r["user_id"]: r["s"] for r in streaming.with_session(tables("events")).groupBy("user_id").agg(F.max("session").alias("s")).collect()}
    assert {r["user_id"]: r["session"] for r in spark.table("live").collect() if r["session"]} == last


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(src)
        streaming.ingest(spark, src, "id long", out, state).awaitTermination(60)
    assert spark.read.parquet(out).count() == 8


def test_merge_edges_refuses_unknown_types(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    edges = spark.createDataFrame([(1, 2, "CITES")], "src long, dst long, rel_type string")
    with pytest.raises(ValueError):
        stores.merge_edges(edges, spark.createDataFrame([(1, 2, "LIKES")], edges.schema), nodes)
    assert stores.merge_edges(edges, spark.createDataFrame([(1, 2, "CITES"), (2, 1, "CITES"), (2, 9, "CITES")], edges.schema), nodes).count() == 2


def test_jsonl_skips_bad_lines_and_keeps_the_last(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "x", "n": 1}\nnot json\n{"chunk_id": "x", "n": 2}\n{"chunk_id": "y", "n": 3}\n')
    rows = stores.read_jsonl(spark, str(tmp_path), "chunk_id string, n int", "chunk_id")
    assert sorted((r["chunk_id"], r["n"]) for r in rows.collect()) == [("x", 2), ("y", 3)]


def test_unknown_agency_is_an_error(spark):
    with pytest.raises(ValueError):
        chunking.chunk_documents(spark.createDataFrame([("f", "t")], "filename string, text string"), "nowhere")


def test_sub_split_keeps_every_token_within_the_limit(spark, tables):
    docs = tables("documents").select(F.col("doc_id").alias("id"), "text")
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\w+|[^\w\s]"), 0)
    rows = docs.select("id", words(F.col("text")).alias("want"), chunking.sub_split(F.col("text"), 50).alias("parts"))
    rows = rows.select("want", F.flatten(F.transform("parts", words)).alias("got"), F.array_max(F.transform("parts", lambda p: F.size(words(p)))).alias("most"))
    for r in rows.collect():
        assert r["got"] == r["want"]
        assert r["most"] is None or r["most"] <= 50


def test_short_sections_are_carried_forward(spark):
    rows = [[("A", "x"), ("B", "y " * 250), ("C", "z")], [("A", "x"), ("B", "y")], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "id int, s array<struct<heading:string,body:string>>")
    got = {r["id"]: [(x["heading"], len(x["body"].split())) for x in r["m"]] for r in df.select("id", chunking.merge_short(F.col("s")).alias("m")).collect()}
    assert got == {0: [("A", 252)], 1: [("A", 2)], 2: []}


def test_resolution_order_and_section_rule(spark):
    rows = [(1, "RCW 36.70A.681", 1), (2, "RCW 36.70A.681", 2), (3, "SMC 23.45.502", 3), (4, "RCW 76.09.010", 4)]
    exact, chapters = citations.index(spark.createDataFrame(rows, "id long, citation string, ord int"))
    ask = ["RCW  36.70A.681", "RCW 36.70A.681(2)(a)", "Section 23.45.502(A)", "RCW 76.09", "RCW 76.09.999", "nothing"]
    got = citations.resolve(spark.createDataFrame([(a,) for a in ask], "citation string"), exact, chapters)
    assert {r["citation"]: r["target"] for r in got.collect()} == dict(zip(ask, [2, 2, 3, 4, None, None]))


def test_reading_seven_of_eight_cells_finds_nine_tenths(spark):
    from lexiloom.plans.answer_queries import vector_index_recall

    from tests.conftest import SF

    assert vector_index_recall(spark, SF).first()["recall"] >= 0.9


def test_weights_override_ignores_bad_parts():
    assert config.weights_from("CITES:0.9, bad, X:y", {"CITES": 0.35, "IMPLEMENTS": 0.75}) == {"CITES": 0.9, "IMPLEMENTS": 0.75}


def test_preamble_without_seeds_or_paths(spark):
    seeds = spark.createDataFrame([(1, 1, None), (1, 2, "A")], "query_id long, pos long, citation string")
    paths = spark.createDataFrame([(2, 1, "CITES", None, None), (2, 2, "", 5, 9.0)], "query_id long, pos long, edge_type string, chunk_id long, score double")
    got = {r["query_id"]: r["preamble"] for r in ranking.preamble(seeds, paths).collect()}
    assert got == {1: "Evidence graph: 2 seeds (A).", 2: "Evidence graph: 0 seeds. CITES chain to ?."}
    assert ranking.preamble(seeds.limit(0), paths.limit(0)).count() == 0


def test_tree_solving_stops_at_its_limit_and_nested_marks_take_the_outer_answer(spark):
    from lexiloom.plans import trees

    rows = [(1, 1, None, "", "sequential", "r"), (1, 2, 1, "0", "leaf", "a"), (1, 3, 1, "1", "sequential", "s"), (1, 4, 3, "0", "leaf", "b [answer_left]"), (1, 5, 3, "1", "leaf", "c [answer_left]"), (2, 1, None, "", "strange", "q")]
    nodes = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, side string, node_type string, query string")
    got = {(r["tree_id"], r["node_id"]): (r["query"], r["answer"]) for r in trees.solve(nodes, lambda q: q.upper() + "x" * 600, most=2).collect()}
    long = "A" + "x" * 499
    assert got[1, 4] == (f"b {long}", f"B {long.upper()}" + "x" * 600) and got[1, 5] == (f"c {long}", "")
    assert got[2, 1][0] == "q" and got[1, 1][1].startswith("Ax")


def test_a_dropped_store_is_gone(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert stores.drop_store(spark, f"file://{tmp_path}/t") and not (tmp_path / "t").exists()
    assert not stores.drop_store(spark, f"file://{tmp_path}/t")


def test_nodes_without_a_document_type_are_substantive(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, None)], "id string, agency string, citation string, section_number string, authority_level string, filename string, chunk_index int")
    assert tuple(stores.load_nodes(df).first()) == ("", "", "", "", "", "substantive", "", 0, 0)
