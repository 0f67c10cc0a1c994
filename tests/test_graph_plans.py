"""Work that graph operators need not do, and the same results without it."""

import re

from lexiloom.operators import graph

EDGES = [(1, 2, "CITES", 1.0), (1, 2, "CITES", 0.5), (2, 3, "CITES", 1.0), (4, 1, "SUBJECT_TO", 1.0), (3, 9, "IMPLEMENTS", 1.0)]


def _edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long, rel_type string, confidence double")


def test_panels_need_no_citations(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,), (4,)], "id long")
    rows = graph.relationship_panel(_edges(spark), spark.createDataFrame([(2,), (2,)], "id long"), ids)
    assert sorted((r["id"], r["panel"], r["other"], r["n"]) for r in rows.collect()) == [(1, "cites", 2, 1), (2, "cited_by", 1, 1), (2, "cites", 3, 1), (4, "subject_to", 1, 1)]


def test_neighbourhood_does_not_gather_all_edges(spark):
    rows = graph.neighbourhood(_edges(spark), spark.createDataFrame([(1,)], "id long"))
    assert not re.search(r"Aggregate \[a#\d+L?, b#", rows._jdf.queryExecution().optimizedPlan().toString())
    assert {r["id"]: r["hop"] for r in rows.collect()} == {1: 0, 2: 1, 4: 1, 3: 2}


def test_chains_take_cosines_in_place_of_vectors(spark):
    chunks = spark.createDataFrame([(i, 1, i) for i in range(5)], "id long, filename long, chunk_index int")
    vectors = spark.createDataFrame([(i, [1.0, float(i == 3)]) for i in range(5)], "id long, vector array<double>")
    scores = spark.createDataFrame([(i, 0.5**0.5 if i == 3 else 1.0) for i in range(5)], "id long, score double")
    rows = [[(r["id"], r["hop"], round(r["score"], 9)) for r in graph.next_chain(chunks, v, chunks.where("id = 1").select("id"), [1.0, 0.0], 0.9).orderBy("id").collect()] for v in (vectors, scores)]
    assert rows[0] == rows[1] == [(0, -1, 1.0), (2, 1, 1.0)]
