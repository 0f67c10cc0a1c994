"""Queries of preambles, breakdowns, defaults, node loading, conversations and tree solving, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, graph, ranking
from ..sources import stores
from . import trees, views


def preamble_text(spark: SparkSession, d: str) -> DataFrame:
    """Per nation: its customers are the seeds, their orders the paths (status and priority as the edge type)."""
    customers = views.table(spark, d, "customer")
    seeds = customers.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("C "), F.col("c_custkey").cast("string"))).alias("citation"))
    orders = views.table(spark, d, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("query_id")), "o_custkey")
    kind = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)))
    return ranking.preamble(seeds, orders.select("query_id", F.col("o_orderkey").alias("pos"), kind.alias("edge_type"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score")))


def source_breakdown(spark: SparkSession, d: str) -> DataFrame:
    chunks = views.chunk(spark, d).withColumn("citation", F.when(F.col("id") % 4 > 0, F.concat(F.lit("D "), F.col("id").cast("string"))))
    lists = views.table(spark, d, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("id"), (F.col("n_chars") / 7).alias("score"))
    return fusion.breakdown(lists, chunks)


def score_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Results with a distance, with missing ones, and without the column."""
    rows = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") / 64).alias("d"))
    scored = fusion.with_score(rows, "d").select(F.lit("distance").alias("kind"), "id", "score")
    return scored.union(fusion.with_score(rows.select("id")).select(F.lit("none"), "id", "score"))


def chunk_nodes(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents")
    some = lambda c, k: F.when(F.col("doc_id") % k > 0, F.col(c))
    chunks = docs.select(F.col("doc_id").alias("id"), some("source", 3).alias("agency"), some("lang", 4).alias("document_type"), F.lit(None).cast("string").alias("citation"), some("lang", 5).alias("section_number"), some("lang", 7).alias("authority_level"), some("source", 2).alias("filename"), some("n_chars", 6).alias("chunk_index"))
    return stores.load_nodes(chunks)


def property_filter(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("source").alias("agency"))
    return graph.with_properties(nodes, {"type": ["en", "fr"], "agency": ["src1", "src2", "src3"], "id": []})


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("updated_at"))


def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    """Places of every conversation of a user in the listing."""
    rows = stores.list_conversations(_conversations(spark, d), F.lit(7)).withColumn("n", F.monotonically_increasing_id())
    first = stores.list_messages(views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("conversation_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("id")).distinct(), F.lit(1))
    return rows.select("id", "title").union(first.select(F.col("id").cast("long"), F.date_format("created_at", "yyyy-MM-dd")))


def conversation_update(spark: SparkSession, d: str) -> DataFrame:
    """Every order's line items are changes of the conversation of its number."""
    items = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_quantity") > 10, F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))).alias("title"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    last = items.groupBy("id").agg(F.max("at").alias("at"), F.max_by("title", "at").alias("title")).select("id", "title", F.col("at.l_shipdate").alias("at"))
    return stores.update_conversations(_conversations(spark, d), last).select("id", "title", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


def tree_solve(spark: SparkSession, d: str) -> DataFrame:
    """A tree a supplier: its name is asked first, and the answer goes into both queries that follow."""
    s = views.table(spark, d, "supplier")
    node = lambda k, parent, side, kind, query: s.select(F.col("s_suppkey").alias("tree_id"), F.lit(k).cast("long").alias("node_id"), F.lit(parent).cast("long").alias("parent_id"), F.lit(side).alias("side"), F.lit(kind).alias("node_type"), query.alias("query"))
    text = F.lit
    nodes = node(1, None, "", "sequential", text("root")).union(node(2, 1, "0", "leaf", F.concat(text("who "), "s_name"))).union(node(3, 1, "1", "parallel", text("about [answer_left]")))
    nodes = nodes.union(node(4, 3, "0", "leaf", text("where is [answer_left]"))).union(node(5, 3, "1", "leaf", F.concat(text("nation "), F.col("s_nationkey").cast("string"), text(" [answer_left] [answer_right]"))))
    return trees.solve(nodes, lambda q: f"<{q}>")


QUERIES = {f.__name__: f for f in (preamble_text, source_breakdown, score_defaults, chunk_nodes, property_filter, conversation_list, conversation_update, tree_solve)}

SQL = {
    "preamble_text": """WITH s AS (SELECT c_nationkey AS q, c_custkey AS pos, CASE WHEN c_custkey % 3 > 0 THEN 'C ' || c_custkey END AS c FROM customer),
  n AS (SELECT q, count(*) AS n FROM s GROUP BY q), f AS (SELECT q, pos, c, row_number() OVER (PARTITION BY q ORDER BY pos) AS k FROM s WHERE c IS NOT NULL),
  c AS (SELECT q, string_agg(c, ', ' ORDER BY pos) AS cs FROM f WHERE k <= 8 GROUP BY q),
  p AS (SELECT c_nationkey AS q, o_orderkey AS pos, o_orderstatus || substr(o_orderpriority, 1, 1) AS e, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'),
  r AS (SELECT *, row_number() OVER (PARTITION BY q, e ORDER BY score DESC, pos) AS k, min(pos) OVER (PARTITION BY q, e) AS first FROM p),
  t AS (SELECT q, e, pos, row_number() OVER (PARTITION BY q ORDER BY first) AS k FROM r WHERE k = 1),
  h AS (SELECT q, string_agg(e || ' chain to ' || pos || '.', ' ' ORDER BY k) AS hs FROM t WHERE k <= 6 GROUP BY q)
SELECT q AS query_id, concat_ws(' ', 'Evidence graph: ' || coalesce(n, 0) || ' seeds' || coalesce(' (' || cs || ')', '') || '.', hs) AS preamble FROM n LEFT JOIN c USING (q) FULL JOIN h USING (q)""",
    "source_breakdown": """SELECT lang AS source, CAST(n AS INTEGER) AS n, CASE WHEN doc_id % 4 > 0 THEN 'D ' || doc_id ELSE '' END AS citation, coalesce(source, '') AS agency, round(score, 4) AS score
FROM (SELECT *, n_chars / 7 AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 5""",
    "score_defaults": "SELECT 'distance' AS kind, p_partkey AS id, CASE WHEN p_size % 5 > 0 THEN 1 - p_size / 64 ELSE 0.5 END::DOUBLE AS score FROM part UNION ALL SELECT 'none', p_partkey, 0.5::DOUBLE FROM part",
    "chunk_nodes": """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS agency, '' AS citation, CASE WHEN doc_id % 5 > 0 THEN lang ELSE '' END AS section_number, CASE WHEN doc_id % 7 > 0 THEN lang ELSE '' END AS authority_level,
  CASE WHEN doc_id % 4 > 0 THEN lang ELSE 'substantive' END AS document_type, CASE WHEN doc_id % 2 > 0 THEN source ELSE '' END AS filename, CASE WHEN doc_id % 6 > 0 THEN n_chars ELSE 0 END AS chunk_index, 0::TINYINT AS deprecated FROM documents""",
    "property_filter": "SELECT doc_id AS id, lang AS type, source AS agency FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3')",
    "conversation_list": """SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_custkey = 7 UNION ALL
SELECT CAST(l_linenumber AS BIGINT), strftime(l_shipdate, '%Y-%m-%d') FROM (SELECT DISTINCT l_linenumber, l_shipdate FROM lineitem WHERE l_orderkey = 1)""",
    "conversation_update": """WITH c AS (SELECT l_orderkey AS id, CASE WHEN l_quantity > 10 THEN l_returnflag || '-' || l_linenumber || '-' || l_partkey END AS title, l_shipdate AS moment, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem)
SELECT o_orderkey AS id, coalesce(c.title, o_orderpriority) AS title, strftime(greatest(o_orderdate, moment), '%Y-%m-%d') AS day FROM orders LEFT JOIN c ON c.id = o_orderkey AND k = 1""",
    "tree_solve": """WITH s AS (SELECT s_suppkey AS t, '<who ' || s_name || '>' AS a, 'who ' || s_name AS q, s_nationkey AS n FROM supplier), w AS (SELECT *, '<where is ' || a || '>' AS b, 'nation ' || n || ' ' || a AS m FROM s),
  x AS (SELECT *, '<' || m || ' >' AS c FROM w)
SELECT t AS tree_id, 1::BIGINT AS node_id, 'root' AS query, a || chr(10) || chr(10) || b || chr(10) || chr(10) || c AS answer FROM x UNION ALL SELECT t, 2, q, a FROM x UNION ALL SELECT t, 3, 'about ' || a, b || chr(10) || chr(10) || c FROM x
UNION ALL SELECT t, 4, 'where is ' || a, b FROM x UNION ALL SELECT t, 5, m || ' [answer_right]', c FROM x""",
}
