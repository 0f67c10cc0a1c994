"""Queries of search, fusion and ranking, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BM25_K, FUSION_WEIGHTS, RETRIEVAL_K, VECTOR_K
from ..operators import fusion, ranking, search
from ..operators.retrieve import hybrid
from . import views

TERMS = "the and attion"
_DUCK_TERM = r"[\p{L}\p{N}]+"


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_topk(views.chunk_vec(spark, d), views.query_vec(spark, d)).select("id", F.round("score", 6).alias("score"))


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = search.vector_topk(views.chunk_vec(spark, d), views.query_vec(spark, d), 10, ["1", "3", "nowhere"], [str(i) for i in range(10)])
    return rows.select("id", F.round("score", 6).alias("score"))


_COS = """vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS VARCHAR) AS agency FROM embeddings),
  q AS (SELECT v AS qv FROM vec WHERE id = 0),
  cos AS (SELECT id, agency, list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) AS score FROM vec, q)"""


def _bm25(where: str = "TRUE", k: int = BM25_K) -> str:
    return f"""docs AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{_DUCK_TERM}') AS words FROM documents WHERE {where}),
  stats AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM docs),
  term AS (SELECT unnest(string_split('{TERMS}', ' ')) AS t),
  tf AS (SELECT id, t, len(words) AS length, len(list_filter(words, lambda w: w = t)) AS tf FROM docs, term),
  df AS (SELECT t, count(*) AS df FROM tf WHERE tf > 0 GROUP BY t),
  bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
         FROM tf JOIN df USING (t), stats WHERE tf > 0 GROUP BY id),
  bm25 AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {k})"""


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_topk(views.chunk(spark, d), TERMS).select("id", F.round("score", 6).alias("score"))


def bm25_index_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_index_topk(search.index_text(views.chunk(spark, d)), TERMS).select("id", F.round("score", 6).alias("score"))


def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_topk(views.chunk(spark, d), TERMS, agencies=["src1", "src2"]).select("id", F.round("score", 6).alias("score"))


def batch_knn(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows of different agencies among each other's 5 nearest, with cosine 0.9 or more (0.25 here);
    the restriction to other agencies is applied after the limit."""
    v = views.chunk_vec(spark, d)
    near = search.batch_knn(v, v, 5)
    agency = v.select("id", "agency")
    near = near.join(agency.withColumnRenamed("id", "query_id").withColumnRenamed("agency", "qa"), "query_id").join(agency, "id")
    near = near.where((F.col("qa") != F.col("agency")) & (F.round("score", 6) >= 0.25))
    return near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).distinct()


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists of parts for every supplier."""
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id"))
    rows = rows.agg(F.max("l_discount").alias("v"), F.max("l_quantity").alias("b"))
    return rows.selectExpr("query_id", "id", "stack(2, 'vector', v, 'bm25', b) AS (source, score)")


_LISTS = """g AS (SELECT l_suppkey AS query_id, l_partkey AS id, max(l_discount) AS v, max(l_quantity) AS b FROM lineitem GROUP BY ALL),
  lists AS (SELECT query_id, id, 'vector' AS source, v AS score FROM g UNION ALL SELECT query_id, id, 'bm25', b FROM g)"""


def linear_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.top(fusion.linear_fuse(_lists(spark, d), by=("query_id",)).withColumn("score", F.round("score", 6)), RETRIEVAL_K, ("query_id",))
    return rows.select("query_id", "id", "score", "rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.top(fusion.rrf_fuse(_lists(spark, d), by=("query_id",)).withColumn("score", F.round("score", 7)), RETRIEVAL_K, ("query_id",))
    return rows.select("query_id", "id", "score", "rank")


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    rows = hybrid(views.chunk_vec(spark, d), views.chunk(spark, d), views.query_vec(spark, d), TERMS)
    return rows.select("id", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"), "agency", "document_type", F.substring("text", 1, 40).alias("excerpt"))


_HYBRID = f"""WITH {_COS}, {_bm25()},
  lists AS (SELECT id, 'vector' AS source, score FROM (SELECT id, score FROM cos ORDER BY score DESC, id LIMIT {VECTOR_K}) UNION ALL SELECT id, 'bm25', score FROM bm25),
  scaled AS (SELECT id, source, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END
                    * CASE source WHEN 'vector' THEN {FUSION_WEIGHTS["vector"]} ELSE {FUSION_WEIGHTS["bm25"]} END AS part FROM lists WINDOW w AS (PARTITION BY source)),
  fused AS (SELECT id, sum(part) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM scaled GROUP BY id),
  best AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT {RETRIEVAL_K})
SELECT id, round(score, 6) AS score, sources, d.source AS agency, lang AS document_type, substr(text, 1, 40) AS excerpt FROM best JOIN documents d ON d.doc_id = best.id"""


def rerank_by_query(spark: SparkSession, d: str) -> DataFrame:
    rows = views.chunk(spark, d).select("id", F.lit(0.5).alias("score"))
    return ranking.rerank(rows, views.chunk_vec(spark, d), views.query_vec(spark, d), "L3").select("id", "score")


def rerank_audit(spark: SparkSession, d: str) -> DataFrame:
    before = search.bm25_topk(views.chunk(spark, d), TERMS).withColumn("score", F.round("score", 6))
    after = ranking.rerank(before, views.chunk_vec(spark, d), views.query_vec(spark, d), "L2")
    return ranking.rerank_audit(before, after.select("id", "score"))


def seed_union(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # lists of 30
    v = search.vector_topk(views.chunk_vec(spark, d), views.query_vec(spark, d)).withColumn("pos", nth)
    b = search.bm25_topk(views.chunk(spark, d), TERMS).withColumn("pos", nth)
    return fusion.union_seeds(v, b)


def leaf_dedup(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as leaves: the rows of a part over all orders."""
    rows = views.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.array("l_returnflag").alias("sources"))
    rows = rows.groupBy("id", "score", "pos").agg(F.array_sort(F.flatten(F.collect_set("sources"))).alias("sources"))
    return ranking.merge_leaves(rows).select("id", "score", "pos", F.array_join("sources", ",").alias("sources"))


_LEAF = """WITH r AS (SELECT l_partkey AS id, l_discount AS score, l_orderkey * 10 + l_linenumber AS pos, list_sort(list_distinct(list(l_returnflag))) AS sources FROM lineitem GROUP BY ALL),
  f AS (SELECT id, score, pos, unnest(sources) AS s, generate_subscripts(sources, 1) AS k FROM r),
  o AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos, k) AS n FROM f),
  u AS (SELECT id, s, min(n) AS n FROM o GROUP BY ALL),
  b AS (SELECT id, max(score) AS score, arg_min(pos, (-score, pos)) AS pos FROM r GROUP BY id)
SELECT b.id, b.score, b.pos, (SELECT string_agg(s, ',' ORDER BY n) FROM u WHERE u.id = b.id) AS sources FROM b"""


def cache_merge(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders")
    now = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("score")).groupBy("id").agg(F.max("score").alias("score")).withColumn("sources", F.array(F.lit("vector")))
    old = o.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("score"))
    return ranking.merge_cache(now, old).select("id", F.round("score", 4).alias("score"), F.array_join("sources", ",").alias("sources"))


def mmr_diverse(spark: SparkSession, d: str) -> DataFrame:
    rows = views.results(spark, d).withColumn("key", F.col("id") % 3)
    return ranking.diverse(rows, 5, ["key"], by=("query_id",)).select("query_id", "id", "rank", F.round("value", 6).alias("value"))


def section_dedup_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and length: those of the first 200 ids' multiples of 7 are seeds."""
    rows = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc"), (F.col("n_chars") % 5).alias("section"), F.col("text"), (F.col("doc_id") % 7 == 0).alias("seed"), F.col("doc_id").alias("pos"))
    return ranking.drop_repeated_sections(rows).select("id", "doc", "section", F.round("novelty", 6).alias("novelty"))


_SECTION = """WITH r AS (SELECT doc_id AS id, source AS doc, n_chars % 5 AS section, text, doc_id % 7 = 0 AS seed, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) >= 3)) AS own FROM documents),
  w AS (SELECT doc, section, coalesce(max(CASE WHEN seed THEN id END), min(CASE WHEN NOT seed THEN id END)) AS id FROM r GROUP BY ALL),
  n AS (SELECT r.id, r.doc, r.section, r.seed, w.id AS winner, CASE WHEN len(r.own) > 0 THEN len(list_filter(r.own, lambda x: NOT list_contains(b.own, x))) / len(r.own)::DOUBLE ELSE 0.0 END AS novelty
        FROM r JOIN w USING (doc, section) JOIN r b ON b.id = w.id)
SELECT id, doc, section, round(novelty, 6) AS novelty FROM n WHERE seed OR winner = id OR novelty > 0.2"""


def _budget_rows(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("vector", "bm25", "graph", "cache", "graph_expand", "conflict_expand", "other"))), (F.col("id") % 7 + 1).cast("int"))
    return views.results(spark, d).withColumn("sources", F.array(kind)).withColumn("tokens", (F.col("id") % 97 + 10).cast("long"))


_BUDGET = f"""r AS (SELECT *, (['vector', 'bm25', 'graph', 'cache', 'graph_expand', 'conflict_expand', 'other'])[id % 7 + 1] AS kind, id % 97 + 10 AS tokens FROM ({views.RESULTS})),
  t AS (SELECT *, CASE kind WHEN 'conflict_expand' THEN 0 WHEN 'graph_expand' THEN 1 WHEN 'cache' THEN 2 WHEN 'graph' THEN 3 WHEN 'bm25' THEN 4 WHEN 'vector' THEN 5 ELSE 3 END AS tier,
        kind = 'conflict_expand' AND row_number() OVER (PARTITION BY query_id, kind = 'conflict_expand' ORDER BY score DESC, id) <= 1 AS reserved FROM r),
  c AS (SELECT *, CASE WHEN reserved THEN 0 ELSE tokens END AS cost FROM t)"""


def token_budget_trim(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.token_budget(_budget_rows(spark, d), 300, 1, by=("query_id",))
    return rows.select("query_id", "id", "tier", "reserved", "trimmed")


def token_budget_documented(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.token_budget(_budget_rows(spark, d), 300, 1, "documented", by=("query_id",))
    return rows.select("query_id", "id", "tier", "reserved", "trimmed")


def _budget_sql(direction: str) -> str:
    return f"""WITH {_BUDGET} SELECT query_id, id, CAST(tier AS INTEGER) AS tier, reserved, NOT reserved AND sum(cost) OVER (PARTITION BY query_id)
  - coalesce(sum(cost) OVER (PARTITION BY query_id ORDER BY reserved, tier, score {direction}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 300 AS trimmed FROM c"""


def knapsack_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = _budget_rows(spark, d).withColumn("cost", F.col("tokens"))
    return ranking.knapsack(rows, 200, ("query_id",)).select("query_id", "id", "used")


_KNAPSACK = f"""WITH RECURSIVE {_BUDGET},
  s AS (SELECT query_id, id, tokens AS cost, row_number() OVER (PARTITION BY query_id ORDER BY -score / greatest(tokens, 1), -score, id) AS n FROM r),
  f AS (SELECT query_id, n, id, CASE WHEN cost <= 200 THEN cost ELSE 0 END AS used, cost <= 200 AS taken FROM s WHERE n = 1
        UNION ALL SELECT s.query_id, s.n, s.id, CASE WHEN f.used + s.cost <= 200 THEN f.used + s.cost ELSE f.used END, f.used + s.cost <= 200 FROM f JOIN s ON s.query_id = f.query_id AND s.n = f.n + 1)
SELECT query_id, id, CAST(max(used) OVER (PARTITION BY query_id) AS BIGINT) AS used FROM f QUALIFY taken"""


def authority_order(spark: SparkSession, d: str) -> DataFrame:
    rows = views.results(spark, d).withColumn("rank", ranking.authority_rank(F.col("authority_level")))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", F.desc("score"), "id"))
    return rows.withColumn("n", n).select("query_id", "id", "rank", "n")


_RANK = "CASE authority_level WHEN 'state_statute' THEN 1 WHEN 'state_admin_rule' THEN 2 WHEN 'court_opinion' THEN 4 WHEN 'local_statute' THEN 5 ELSE 7 END"


def hierarchy_callouts(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return ranking.hierarchy_callouts(views.results(spark, d).withColumn("n", n), ("query_id",))


def conflict_signal(spark: SparkSession, d: str) -> DataFrame:
    return ranking.conflict_signal(views.results(spark, d), ("query_id",))


def confidence_label(spark: SparkSession, d: str) -> DataFrame:
    rows = views.results(spark, d).withColumn("confidence", ranking.confidence(F.col("score")))
    return rows.groupBy("confidence").agg(F.count("*").alias("n"))


def relative_confidence(spark: SparkSession, d: str) -> DataFrame:
    return ranking.relative_confidence(views.results(spark, d), ("query_id",)).select("query_id", "id", "confidence")


_ANSWERS = [
    (1, "See [RCW 36.70A.681] and [WAC 365-196-410], again [RCW 36.70A.681]. Not [1] or [link](x)."),
    (2, "Only [SMC 23.45.502(A)] counts; [EO 24-01] is unknown; [RCW 1.2.3] too."),
    (3, "Nothing here."),
]
_SOURCES = [(10, "RCW 36.70A.681", 0.4), (11, "RCW 36.70A.681", 0.9), (12, "WAC 365-196-410", 0.7), (13, "SMC 23.45.502(A)", 0.7)]


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def claim_extraction(spark: SparkSession, d: str) -> DataFrame:
    answers = spark.createDataFrame(_ANSWERS, "answer_id long, text string")
    sources = spark.createDataFrame(_SOURCES, "id long, citation string, score double")
    found, unknown = ranking.claims(answers, sources)
    return found.select("answer_id", "citation", "n", "source_id", "score").unionByName(unknown.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)


_CLAIMS = rf"""WITH a(answer_id, text) AS (VALUES {_values(_ANSWERS)}), s(id, citation, score) AS (VALUES {_values(_SOURCES)}),
  f AS (SELECT CAST(answer_id AS BIGINT) AS answer_id, unnest(regexp_extract_all(text, '\[((?:RCW|WAC|SMC|DR|EO|IBC|SPU)\s[^\]\[]+)\]', 1)) AS citation FROM a),
  g AS (SELECT answer_id, citation, count(*) AS n FROM f GROUP BY ALL),
  b AS (SELECT citation, CAST(arg_max(id, score) AS BIGINT) AS source_id, CAST(max(score) AS DOUBLE) AS score FROM s GROUP BY citation)
SELECT answer_id, citation, CASE WHEN source_id IS NULL THEN 0 ELSE n END AS n, source_id, score FROM g LEFT JOIN b USING (citation)"""


def first_last_sentence(spark: SparkSession, d: str) -> DataFrame:
    rows = views.chunk(spark, d).select("id", ranking.first_and_last(F.col("text")).alias("extract"))
    return rows.select("id", F.length("extract").alias("n"), F.substring("extract", 1, 30).alias("head"))


def sources_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.top(views.results(spark, d), 12)
    return ranking.sources_summary(ranking.authority_order(rows))


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.top(views.results(spark, d), 20).withColumn("sources", F.when(F.col("id") % 2 == 0, F.array(F.lit("conflict_expand"))).otherwise(F.array(F.lit("bm25"))))
    return ranking.context_blocks(rows.withColumn("text", F.concat(F.lit("order "), F.col("id").cast("string"))))


def compose_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best documents by BM25 seed a prompt; its 60 nearest documents by vector expand it."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc"), (F.col("n_chars") % 5).alias("section"), "text", F.floor(F.col("n_chars") / 4).cast("long").alias("cost"))
    nth = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # lists of 20 and 60
    seeds = search.bm25_topk(views.chunk(spark, d), TERMS, 20).withColumn("pos", nth.cast("long")).join(docs, "id")
    more = search.vector_topk(views.chunk_vec(spark, d), views.query_vec(spark, d), 60).join(seeds.select("id"), "id", "left_anti")
    more = more.withColumn("pos", nth.cast("long")).join(docs, "id")
    return ranking.compose(seeds.select("id", "pos", "cost", "doc", "section", "text"), more.select("id", "pos", "cost", "score", "doc", "section", "text"), 12_000, 200)


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_filtered, bm25_topk, bm25_index_topk, bm25_topk_filtered, batch_knn, linear_fusion, rrf_fusion, hybrid_retrieve, rerank_by_query, rerank_audit,
        seed_union, leaf_dedup, cache_merge, mmr_diverse, section_dedup_novelty, token_budget_trim, token_budget_documented, knapsack_budget, authority_order, hierarchy_callouts,
        conflict_signal, confidence_label, relative_confidence, claim_extraction, first_last_sentence, sources_summary, context_blocks, compose_prompt,
    )
}

_TOP_BM = "SELECT id, round(score, 6) AS score FROM bm25"
SQL = {
    "vector_topk": f"WITH {_COS} SELECT id, round(score, 6) AS score FROM cos ORDER BY cos.score DESC, id LIMIT {VECTOR_K}",
    "vector_topk_filtered": f"WITH {_COS} SELECT id, round(score, 6) AS score FROM cos WHERE agency IN ('1', '3') ORDER BY cos.score DESC, id LIMIT 10",
    "bm25_topk": f"WITH {_bm25()} {_TOP_BM}",
    "bm25_index_topk": f"WITH {_bm25()} {_TOP_BM}",
    "bm25_topk_filtered": "WITH " + _bm25("source IN ('src1', 'src2')") + " " + _TOP_BM,
    "batch_knn": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
  p AS (SELECT a.id AS qid, b.id, a.label AS qa, b.label AS la, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS score FROM v a JOIN v b ON a.id <> b.id),
  k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) <= 5)
SELECT DISTINCT least(qid, id) AS a, greatest(qid, id) AS b FROM k WHERE qa <> la AND round(score, 6) >= 0.25""",
    "linear_fusion": f"""WITH {_LISTS}, s AS (SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END
  * CASE source WHEN 'vector' THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END AS part FROM lists WINDOW w AS (PARTITION BY query_id, source)),
  f AS (SELECT query_id, id, round(sum(part), 6) AS score FROM s GROUP BY ALL)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 15""",
    "rrf_fusion": f"""WITH {_LISTS}, s AS (SELECT query_id, id, CASE source WHEN 'vector' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END / (60 + row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id)) AS part FROM lists),
  f AS (SELECT query_id, id, round(sum(part), 7) AS score FROM s GROUP BY ALL)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 15""",
    "hybrid_retrieve": _HYBRID,
    "rerank_by_query": f"WITH {_COS} SELECT doc_id AS id, round(greatest(coalesce(score, 0), 0), 4) AS score FROM documents LEFT JOIN cos ON id = doc_id ORDER BY coalesce(cos.score, 0) DESC, doc_id LIMIT 20",
    "rerank_audit": f"""WITH {_COS}, {_bm25()}, b AS (SELECT id, round(score, 6) AS score_before, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank_before FROM bm25),
  r AS (SELECT b.id, coalesce(cos.score, 0) AS raw FROM b LEFT JOIN cos USING (id) ORDER BY raw DESC, b.id LIMIT 12),
  a AS (SELECT id, round(greatest(raw, 0), 4) AS score_after, CAST(row_number() OVER (ORDER BY round(greatest(raw, 0), 4) DESC, id) AS INTEGER) AS rank_after FROM r)
SELECT id, score_before, rank_before, score_after, rank_after, rank_before - rank_after AS change, rank_after IS NOT NULL AS kept FROM b LEFT JOIN a USING (id)""",
    "seed_union": f"""WITH {_COS}, {_bm25()}, v AS (SELECT id, score FROM cos ORDER BY score DESC, id LIMIT {VECTOR_K}),
  u AS (SELECT id, 0 AS list, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS pos FROM v UNION ALL SELECT id, 1, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) FROM bm25)
SELECT id, list, pos FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY list, pos) = 1""",
    "leaf_dedup": _LEAF,
    "cache_merge": """WITH n AS (SELECT o_custkey AS id, max(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), o AS (SELECT o_custkey AS id, max(o_totalprice) AS score FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
SELECT id, round(score, 4) AS score, 'vector' AS sources FROM n UNION ALL SELECT id, round(score * 0.8::DOUBLE, 4), 'cache' FROM o ANTI JOIN n USING (id)""",
    "mmr_diverse": f"""WITH r AS ({views.RESULTS}), v AS (SELECT query_id, id, score, 0.7::DOUBLE * score - CASE WHEN row_number() OVER (PARTITION BY query_id, id % 3 ORDER BY score DESC, id) > 1 THEN 1 - 0.7::DOUBLE ELSE 0.0 END AS value FROM r)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY value DESC, score DESC, id) AS INTEGER) AS rank, round(value, 6) AS value FROM v QUALIFY rank <= 5""",
    "section_dedup_novelty": _SECTION,
    "token_budget_trim": _budget_sql("DESC"),
    "token_budget_documented": _budget_sql("ASC"),
    "knapsack_budget": _KNAPSACK,
    "authority_order": f"SELECT query_id, id, {_RANK} AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_RANK}, score DESC, id) AS INTEGER) AS n FROM ({views.RESULTS})",
    "hierarchy_callouts": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM ({views.RESULTS})),
  g AS (SELECT query_id, arg_min(citation, n) FILTER (authority_level = 'state_statute') AS statute, arg_min(citation, n) FILTER (authority_level = 'state_admin_rule') AS rule,
        arg_min(citation, n) FILTER (authority_level IN ('local_statute', 'local_admin_rule')) AS local FROM r GROUP BY query_id)
SELECT *, statute IS NOT NULL AND rule IS NOT NULL AS rule_under_statute, statute IS NOT NULL AND local IS NOT NULL AS local_under_statute FROM g""",
    "conflict_signal": f"""SELECT query_id, count(*) AS n, count(DISTINCT agency) AS n_agencies, max({_RANK}) - min({_RANK}) AS spread, array_to_string(list_sort(list(DISTINCT agency)), ', ') AS agencies
FROM ({views.RESULTS}) WHERE score > 0.5 GROUP BY query_id HAVING n >= 2 AND n_agencies >= 2 AND spread >= 3""",
    "confidence_label": f"SELECT CASE WHEN score > 0.8::DOUBLE THEN 'strongly_supported' WHEN score >= 0.5 THEN 'reasonably_inferred' ELSE 'uncertain' END AS confidence, count(*) AS n FROM ({views.RESULTS}) GROUP BY 1",
    "relative_confidence": f"""WITH r AS (SELECT query_id, id, score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN NULL ELSE max(score) OVER (PARTITION BY query_id) END AS ratio FROM ({views.RESULTS}))
SELECT query_id, id, CASE WHEN ratio >= 0.7::DOUBLE THEN 'high' WHEN ratio >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM r""",
    "claim_extraction": _CLAIMS,
    "first_last_sentence": r"""WITH s AS (SELECT doc_id AS id, text, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9\[("])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents),
  e AS (SELECT id, CASE WHEN len(p) <= 2 THEN text ELSE p[1] || ' ' || p[-1] END AS extract FROM s)
SELECT id, CAST(length(extract) AS INTEGER) AS n, substr(extract, 1, 30) AS head FROM e""",
    "sources_summary": f"""WITH r AS (SELECT * FROM ({views.RESULTS}) ORDER BY score DESC, id LIMIT 12), n AS (SELECT *, row_number() OVER (ORDER BY {_RANK}, score DESC, id) AS n FROM r)
SELECT string_agg(n || '. ' || citation || ' (' || agency || ')', '; ' ORDER BY n) AS summary FROM n""",
    "context_blocks": f"""WITH r AS (SELECT * FROM ({views.RESULTS}) ORDER BY score DESC, id LIMIT 20), n AS (SELECT *, CAST(row_number() OVER (ORDER BY {_RANK}, score DESC, id) AS INTEGER) AS n FROM r)
SELECT n, id, CASE WHEN id % 2 = 0 THEN '[conflict] ' ELSE '' END || '[' || n || '] ' || citation || ' (' || agency || ') order ' || id AS block FROM n""",
}
