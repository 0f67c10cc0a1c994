"""Queries of embedding, later resolution, adjudication and the whole answer path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations, embedding, resolution, search
from ..operators.retrieve import citation_path
from . import answer, views
from .graph_queries import _PARTS, _REFS, _numbered, _references, _seeds
from .search_queries import TERMS, _values


def embedding_stub(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur more than once have one vector."""
    rows = views.table(spark, d, "documents").select("text", embedding.hashed_vector(F.col("text"), 16).alias("v"))
    return rows.groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("v").alias("vectors")).where("n > 1").agg(F.count("*").alias("texts"), F.sum("n").alias("rows"), F.max("vectors").alias("vectors"))


def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """The model seam with a model that gives length and spaces."""
    rows = views.chunk(spark, d)
    return embedding.embed(rows, lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]).select("id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


def ann_search(spark: SparkSession, d: str) -> DataFrame:
    """k-means cells, all of them read: the exact top 10."""
    v = views.chunk_vec(spark, d)
    placed, centroids = embedding.cells(v, 8)
    return embedding.probe(placed, centroids, views.query_vec(spark, d), 10, 8).select("id", F.round("score", 6).alias("score"))


def isolated_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("text")).alias("content"))
    out = embedding.isolated(rows, lambda c: c.split("\n") if c else [] if c is not None else 1 / 0)
    return out.groupBy("status", "error").agg(F.count("*").alias("n"), F.sum(F.size("parts")).alias("parts"))


def on_demand_resolve(spark: SparkSession, d: str) -> DataFrame:
    exact, chapters = citations.index(_numbered(spark, d))
    refs = _references(spark, d).select(F.col("source").alias("id"), F.concat(F.lit("see "), F.trim("citation"), F.lit(" there")).alias("text"))
    known = _references(spark, d).where("source % 2 = 0").select(F.col("source").alias("src"), (F.col("source") % 2500 + 1).alias("dst"), F.lit("CITES").alias("rel_type"))
    return resolution.on_demand(refs, known, exact, chapters).groupBy(F.col("src") % 6).agg(F.count("*").alias("n"), F.sum("dst").alias("targets")).withColumnRenamed("(src % 6)", "form")


def incremental_retry(spark: SparkSession, d: str) -> DataFrame:
    exact, chapters = citations.index(_numbered(spark, d))
    edges, left = resolution.retry(_references(spark, d).withColumn("rel_type", F.lit("CITES")), exact, chapters)
    return edges.agg(F.lit("edges").alias("what"), F.count("*").alias("n")).union(left.agg(F.lit("unresolved"), F.count("*")))


def adjudicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents of neighbouring ids; the stand-in judge finds a conflict where lengths differ threefold."""

    def judge(a: str, b: str) -> dict:
        if len(a) % 7 == 0:
            return {"conflict": True}  # lacks keys
        return {"conflict": len(a) > 3 * len(b) or len(b) > 3 * len(a), "description": f"{len(a)}/{len(b)}", "resolution": "stricter"}

    c = views.chunk(spark, d)
    pairs = c.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return resolution.adjudicate(pairs, c, judge)


_PATHS = [("WAC", "WAC 365-196-410", None), ("RCW", "RCW 36.70A.681", "RCW 36.70A"), ("SMC", "SMC 23.45.502", ""), ("EO", "EO", None)]


def citation_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_PATHS, "agency string, citation string, parent string")
    return rows.select(citation_path(F.col("agency"), F.col("citation"), F.col("parent")).alias("p")).select("p.*")


_PATH_ROWS = [("WAC", "WAC 365-196", "WAC 365-196-410"), ("RCW", "RCW 36.70A", "RCW 36.70A.681"), ("SMC", "SMC 23.45", "SMC 23.45.502"), ("EO", "EO", "EO")]


def sources_event(spark: SparkSession, d: str) -> DataFrame:
    rows = views.results(spark, d).withColumn("section", F.when(F.col("id") % 3 == 0, "NaN").otherwise(F.col("citation")))
    return answer.sources_event(rows.withColumn("score", F.col("score") / 3))


def rendered_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = views.results(spark, d)
    return rows.select("id", answer.render(F.col("citation"), F.col("agency"), F.col("authority_level")).alias("block"))


def answer_context(spark: SparkSession, d: str) -> DataFrame:
    """The whole path on the documents: suppliers' parts are the edges between documents of those ids."""
    chunks = views.chunk(spark, d).withColumn("citation", F.concat(F.lit("D "), F.col("id").cast("string")))
    level = F.element_at(F.array(*map(F.lit, ("state_statute", "state_admin_rule", "local_statute", "guidance"))), (F.col("id") % 4 + 1).cast("int"))
    vectors = views.chunk_vec(spark, d)
    corpus = answer.Corpus(chunks.withColumn("authority_level", level), vectors, views.implements(spark, d))
    rows = answer.context(corpus, views.query_vec(spark, d), TERMS, "L3", most_tokens=6_000)
    return rows.select("n", "id", F.round("score", 4).alias("score"), F.array_join("sources", ",").alias("sources"), "tokens", "authority_level")


def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of ten queries' exact 10 nearest that seven of eight cells give (these vectors hardly cluster:
    four cells give three quarters)."""
    v = views.chunk_vec(spark, d)
    placed, centroids = embedding.cells(v, 8)
    placed = placed.cache()
    exact = search.batch_knn(v.join(_seeds(spark, range(10)), "id"), v, 10).groupBy("query_id").agg(F.collect_set("id").alias("want"))
    got = None
    for r in v.where("id < 10").select("id", "vector").collect():
        one = embedding.probe(placed, centroids, list(r["vector"]), 11, 7).where(F.col("id") != r["id"]).limit(10).agg(F.lit(r["id"]).alias("query_id"), F.collect_set("id").alias("got"))
        got = one if got is None else got.union(one)
    return exact.join(got, "query_id").agg((F.sum(F.size(F.array_intersect("want", "got"))) / F.sum(F.size("want"))).alias("recall"))


QUERIES = {
    f.__name__: f
    for f in (embedding_stub, embed_batches, ann_search, isolated_parse, on_demand_resolve, incremental_retry, adjudicate_pairs, citation_paths, sources_event, rendered_chunks, answer_context, vector_index_recall)
}

_LOCAL = f"WITH {_PARTS}, {_REFS}"
SQL = {
    "embedding_stub": "WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS rows, 1::BIGINT AS vectors FROM g",
    "embed_batches": "SELECT doc_id AS id, CAST(length(text) AS DOUBLE) AS x, CAST(len(string_split(text, ' ')) - 1 AS DOUBLE) AS y FROM documents",
    "ann_search": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS qv FROM v WHERE id = 0)
SELECT id, round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 6) AS score FROM v, q ORDER BY list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) DESC, id LIMIT 10""",
    "isolated_parse": """SELECT CASE WHEN doc_id % 10 = 0 THEN 'skipped' WHEN doc_id % 10 = 1 THEN 'failed' WHEN text = '' THEN 'skipped' ELSE 'success' END AS status, CASE WHEN doc_id % 10 = 1 THEN 'ZeroDivisionError: division by zero' END AS error,
  count(*) AS n, CAST(sum(CASE WHEN doc_id % 10 > 1 THEN len(string_split(text, chr(10))) ELSE 0 END) AS BIGINT) AS parts FROM documents GROUP BY 1, 2""",
    "incremental_retry": f"{_LOCAL}, t AS (SELECT source, target FROM n LEFT JOIN best USING (source)) SELECT 'edges' AS what, count(*) AS n FROM t WHERE target <> source UNION ALL SELECT 'unresolved', count(*) FROM t WHERE target IS NULL",
    "adjudicate_pairs": """WITH d AS (SELECT doc_id, least(length(text), 500) AS n FROM documents), p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM d x JOIN d y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 2 = 0)
SELECT a, b, na % 7 <> 0 AND (na > 3 * nb OR nb > 3 * na) AS conflict, CASE WHEN na % 7 = 0 THEN '' ELSE na || '/' || nb END AS description, CASE WHEN na % 7 = 0 THEN '' ELSE 'stricter' END AS resolution FROM p""",
    "citation_paths": f"SELECT a AS agency, b AS document, c AS section FROM (VALUES {_values(_PATH_ROWS)}) t(a, b, c)",
    "sources_event": f"SELECT id, round(score / 3, 3) AS score, citation, CASE WHEN id % 3 > 0 THEN citation END AS section FROM ({views.RESULTS})",
    "rendered_chunks": f"SELECT id, '[' || citation || ' | ' || agency || ']' || chr(10) || authority_level AS block FROM ({views.RESULTS})",
}
