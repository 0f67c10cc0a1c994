"""Queries of stores, sessions and question trees, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, streaming
from ..sources import stores
from . import trees, views
from .search_queries import _values

# ---- stores ------------------------------------------------------------------------------


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files with a status each; nations' customers as agencies."""
    o, c = views.table(spark, d, "orders"), views.table(spark, d, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "failed").otherwise("in_progress")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return rows.select(F.col("o_orderkey").alias("path"), status.alias("status"), F.col("c_mktsegment").alias("agency"), (F.col("o_orderkey") % 9).alias("chunk_count"))


_MANIFEST = """m AS (SELECT o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'in_progress' END AS status, c_mktsegment AS agency, o_orderkey % 9 AS chunk_count
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def manifest_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    paths = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"))
    m = _manifest(spark, d).where("path % 5 <> 0")  # a fifth of the files is not tracked yet
    one = stores.unprocessed(paths, m).withColumn("resume", F.lit(False))
    return one.union(stores.unprocessed(paths, m, True).withColumn("resume", F.lit(True)))


def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    return stores.manifest_summary(_manifest(spark, d))


def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("at"), F.col("event_type").alias("status"))
    return stores.latest(e)


def merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    new = views.table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("id"), F.lit("new").alias("label"))
    return stores.merge_nodes(c, new)


_NO_NODE = 1 << 62  # added to a key it gives one that no node has, however many there are


def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    e = views.implements(spark, d).where("dst % 2 = 0")
    new = views.implements(spark, d).withColumn("confidence", F.lit(0.5)).withColumn("dst", F.when(F.col("dst") % 3 > 0, F.col("dst")).otherwise(F.col("dst") + _NO_NODE))
    nodes = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).union(views.table(spark, d, "part").select("p_partkey")).distinct()
    return stores.merge_edges(e, new, nodes).select("src", "dst", "rel_type", "confidence")


def load_edges(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "CITES").when(F.col("l_returnflag") == "N", "MADE_UP").otherwise("SUBJECT_TO")
    rows = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.when(F.col("l_partkey") % 7 > 0, F.col("l_partkey")).alias("dst"), kind.alias("rel_type"))
    return stores.load_edges(rows).groupBy("rel_type").agg(F.count("*").alias("n"))


def completeness_report(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").join(views.table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select(F.col("source").alias("agency"), F.when(F.col("quality") == 1, "t").alias("section_title"), F.when(F.col("n_chars") > 1000, "a").otherwise("").alias("authority_level"), F.when(F.col("toxic") == 0, "c").alias("citation"))
    return stores.completeness(rows)


def etl_summary(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return m.groupBy("agency", "status").agg(F.count("*").alias("files"), F.sum("chunk_count").alias("chunks"))


def embedding_cost(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import token_count

    return stores.cost(views.table(spark, d, "documents").select(token_count(F.col("text")).alias("tokens")))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = views.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return stores.by_ids(views.chunk(spark, d), ids, "agency", "document_type")


def page_text(spark: SparkSession, d: str) -> DataFrame:
    t = stores.html_text(F.col("html"))
    rows = views.table(spark, d, "pages").select("page_id", t.alias("text"))
    return rows.select("page_id", F.length("text").alias("n"), F.md5("text").alias("hash"), stores.needs_ocr(F.col("text"), F.lit(20)).alias("ocr"))


_PAGE = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<nav\b.*?</nav\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
  c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
  e AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS t FROM c)
SELECT page_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS hash, length(t) / 20.0 < 50 AS ocr FROM e"""


def trace_split(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("trace_json"))
    inline, off = stores.split_traces(rows, 2000)
    back = stores.read_traces(inline, off).join(off.select("id", F.lit(True).alias("off")), "id", "left")
    return back.select("id", F.coalesce("off", F.lit(False)).alias("offloaded"), F.octet_length("trace_json").alias("bytes"))


def trace_stages(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("timestamp"), F.col("event_type").alias("stage"), F.col("value").alias("elapsed_ms"), F.col("props").alias("data"))
    return stores.stages(e).select("trace_id", F.size("stages").alias("n"), F.array_join(F.transform(F.slice("stages", 1, 5), lambda s: s["stage"]), ",").alias("head"))


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("created_at"))


def retention_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return stores.expired(_conversations(spark, d), F.lit("1996-01-01 00:00:00").cast("timestamp")).select("id")


def conversation_cap(spark: SparkSession, d: str) -> DataFrame:
    return stores.over_cap(_conversations(spark, d), 5).select("id", "user_id")


def orphan_cleanup(spark: SparkSession, d: str) -> DataFrame:
    messages = views.table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("conversation_id"))
    return stores.orphans(_conversations(spark, d), messages).select("id")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    messages = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("conversation_id"))
    c, m = stores.cascade_delete(_conversations(spark, d), messages, stores.over_cap(_conversations(spark, d), 5))
    return c.agg(F.lit("conversations").alias("what"), F.count("*").alias("n")).union(m.agg(F.lit("messages"), F.count("*")))


def owned_conversations(spark: SparkSession, d: str) -> DataFrame:
    owners = views.table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("user_id"))
    return stores.owned(_conversations(spark, d), owners).select("id", "user_id")


_USERS, _NEW = [(1, "a@x.org"), (2, "B@x.org")], [(3, "A@X.org"), (4, "c@x.org"), (5, "C@x.org"), (6, "d@x.org")]


def register_users(spark: SparkSession, d: str) -> DataFrame:
    yes, no = stores.register(spark.createDataFrame(_USERS, "id long, email string"), spark.createDataFrame(_NEW, "id long, email string"))
    return yes.withColumn("accepted", F.lit(True)).union(no.withColumn("accepted", F.lit(False)))


# ---- sessions ----------------------------------------------------------------------------


def session_ttl(spark: SparkSession, d: str) -> DataFrame:
    return streaming.sessions(views.table(spark, d, "events"))


_SESSIONS = """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 60 MINUTES, TRUE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, CAST(sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g)"""


def session_numbers(spark: SparkSession, d: str) -> DataFrame:
    return streaming.with_session(views.table(spark, d, "events")).select("event_id", "user_id", "session")


def stream_session_ttl(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, in one run over what is there: sessions that the watermark has closed."""
    schema = views.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = streaming.closed(streaming.stream_sessions(stream))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def last_n_turns(spark: SparkSession, d: str) -> DataFrame:
    return streaming.last_turns(views.table(spark, d, "conversations"), 2).select("conv_id", "turn", "role")


def _seen(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.floor(F.col("value")).cast("long").alias("id"), F.col("event_id").alias("seq"), F.concat(F.lit("C "), (F.col("event_id") % 13).cast("string")).alias("citation"))


def chunk_cache(spark: SparkSession, d: str) -> DataFrame:
    return streaming.chunk_cache(_seen(spark, d), 20)


def citation_map(spark: SparkSession, d: str) -> DataFrame:
    return streaming.citation_map(_seen(spark, d))


def filter_carry(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("agency_filter"))
    return streaming.carried_filter(e).select("session", "seq", "in_force")


def rewrite_context(spark: SparkSession, d: str) -> DataFrame:
    return streaming.rewrite_context(views.table(spark, d, "conversations"))


# ---- trees -------------------------------------------------------------------------------

_NODES = [
    (1, 1, None, "", "sequential", "root"), (1, 2, 1, "0", "leaf", "what is x"), (1, 3, 1, "1", "leaf", "is [answer_left] y"),
    (2, 1, None, "", "parallel", "root"), (2, 2, 1, "0", "leaf", "a"), (2, 3, 1, "1", "leaf", "b"),
    (3, 1, None, "", "sequential", "root"), (3, 2, 1, "0", "parallel", "l"), (3, 3, 2, "0", "sequential", "ll"), (3, 4, 3, "0", "leaf", "lll"), (3, 5, 3, "1", "leaf", "llr"), (3, 6, 2, "1", "leaf", "lr"), (3, 7, 1, "1", "leaf", "r"),
    (4, 1, None, "", "leaf", "single"), (5, 1, None, "", "leaf", "other"), (6, 1, None, "", "parallel", "p"), (6, 2, 1, "0", "leaf", "pa"), (6, 3, 1, "1", "leaf", "pb"),
]
_GROUPS = [("q1", 3, 1), ("q1", 1, 2), ("q1", 2, 3), ("q2", 4, 1), ("q2", 6, 2), ("q2", 3, 3), ("q3", 5, 1)]
_NODE_TYPES = "tree_id long, node_id long, parent_id long, side string, node_type string, query string"


def _nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_NODES, _NODE_TYPES)


_TREE = f"""RECURSIVE n(tree_id, node_id, parent_id, side, node_type, query) AS (VALUES {_values(_NODES)}),
  t AS (SELECT tree_id, node_id, 1 AS depth, '' AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.tree_id, n.node_id, t.depth + 1, t.path || n.side FROM n JOIN t ON n.tree_id = t.tree_id AND n.parent_id = t.node_id)"""


def tree_depth(spark: SparkSession, d: str) -> DataFrame:
    return trees.shape(_nodes(spark))


def tree_consensus(spark: SparkSession, d: str) -> DataFrame:
    return trees.consensus(_nodes(spark), spark.createDataFrame(_GROUPS, "question string, tree_id long, pos int"))


def tree_truncate(spark: SparkSession, d: str) -> DataFrame:
    return trees.truncate(_nodes(spark), 2).select("tree_id", "node_id", "node_type")


def retrieval_plan(spark: SparkSession, d: str) -> DataFrame:
    return trees.retrieval_plan(_nodes(spark), 2)


def leaf_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = views.results(spark, d).withColumn("text", F.concat(F.col("citation"), F.lit(" of "), F.col("agency")))
    return trees.leaf_answer(rows)


_ANSWER = f"""WITH r AS (SELECT query_id, citation || ' of ' || agency AS t, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM ({views.RESULTS}))
SELECT query_id, string_agg(t, ' ' ORDER BY n) AS answer FROM r WHERE n <= 3 GROUP BY query_id"""


def level_checks(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "orders").select(F.concat(F.lit("l"), (F.col("o_orderkey") % 9).cast("string")).alias("raw"))
    return e.groupBy(trees.valid_level(F.col("raw")).alias("level")).agg(F.count("*").alias("n"))


def premise_corrections(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").select("doc_id", ((F.col("doc_id") % 10) / 10.0).alias("score"), "text")
    return rows.select("doc_id", trees.premise_correction(F.col("score"), F.col("text")).alias("correction")).where("correction is not null")


def weights_override(spark: SparkSession, d: str) -> DataFrame:
    w = config.weights_from("CITES: 0.5,bad,X:y,NEW:1", config.EDGE_WEIGHTS)
    return spark.createDataFrame(sorted(w.items()), "rel_type string, weight double")


QUERIES = {
    f.__name__: f
    for f in (
        manifest_unprocessed, manifest_summary, manifest_latest, merge_nodes, merge_edges, load_edges, completeness_report, etl_summary, embedding_cost, point_lookup, page_text,
        trace_split, trace_stages, retention_cleanup, conversation_cap, orphan_cleanup, cascade_delete, owned_conversations, register_users, session_ttl, session_numbers, stream_session_ttl, last_n_turns,
        chunk_cache, citation_map, filter_carry, rewrite_context, tree_depth, tree_consensus, tree_truncate, retrieval_plan, leaf_answers, level_checks, premise_corrections, weights_override,
    )
}

_CONV = "c AS (SELECT o_orderkey AS id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)"
SQL = {
    "manifest_unprocessed": f"""WITH {_MANIFEST} SELECT o_orderkey AS path, r AS resume FROM orders LEFT JOIN m ON path = o_orderkey AND path % 5 <> 0, (VALUES (FALSE), (TRUE)) t(r)
WHERE status IS NULL OR status = 'in_progress' OR (r AND status = 'failed')""",
    "manifest_summary": f"""WITH {_MANIFEST} SELECT agency, count(*) AS n, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'in_progress') AS in_progress,
  CAST(sum(chunk_count) AS BIGINT) AS chunks FROM m GROUP BY GROUPING SETS ((), (agency))""",
    "manifest_latest": "SELECT user_id AS path, max(event_id) AS at, arg_max(event_type, event_id) AS status FROM events GROUP BY 1",
    "merge_nodes": "SELECT c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT DISTINCT o_custkey * 2, 'new' FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)",
    "merge_edges": f"""WITH e AS ({views.IMPLEMENTS}), n AS (SELECT s_suppkey AS id FROM supplier UNION SELECT p_partkey FROM part)
SELECT src, dst, rel_type, confidence FROM e WHERE dst % 2 = 0 UNION ALL SELECT src, dst, rel_type, 0.5 FROM e WHERE dst % 2 = 1 AND dst % 3 > 0 AND dst IN (SELECT id FROM n) AND src IN (SELECT id FROM n)""",
    "load_edges": "SELECT CASE l_returnflag WHEN 'A' THEN 'CITES' ELSE 'SUBJECT_TO' END AS rel_type, count(*) AS n FROM lineitem WHERE l_partkey % 7 > 0 AND l_returnflag <> 'N' GROUP BY 1",
    "completeness_report": """SELECT source AS agency, round(avg((CASE WHEN trim(source) <> '' THEN 1 ELSE 0 END + CASE WHEN quality = 1 THEN 1 ELSE 0 END + CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END + CASE WHEN toxic = 0 THEN 1 ELSE 0 END) / 4.0::DOUBLE) * 100, 1) AS complete, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "etl_summary": f"WITH {_MANIFEST} SELECT agency, status, count(*) AS files, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM m GROUP BY ALL",
    "embedding_cost": r"WITH t AS (SELECT CAST(sum(len(regexp_extract_all(text, '\w+|[^\w\s]'))) AS BIGINT) AS n FROM documents) SELECT n AS tokens, round(n / 1000000.0::DOUBLE * 0.13::DOUBLE, 6) AS dollars FROM t",
    "point_lookup": "SELECT doc_id AS id, source AS agency, lang AS document_type FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "page_text": _PAGE,
    "trace_split": "SELECT doc_id AS id, strlen(text) > 2000 AS offloaded, CAST(strlen(text) AS INTEGER) AS bytes FROM documents",
    "trace_stages": "SELECT user_id AS trace_id, CAST(count(*) AS INTEGER) AS n, array_to_string(list(event_type ORDER BY event_id)[1:5], ',') AS head FROM events GROUP BY 1",
    "retention_cleanup": "SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 90 DAYS",
    "conversation_cap": f"WITH {_CONV} SELECT id, user_id FROM c WHERE n > 5",
    "orphan_cleanup": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
    "cascade_delete": f"WITH {_CONV} SELECT 'conversations' AS what, count(*) AS n FROM c WHERE n <= 5 UNION ALL SELECT 'messages', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM c WHERE n > 5)",
    "owned_conversations": "SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    "register_users": "SELECT CAST(a AS BIGINT) AS id, b AS email, c AS accepted FROM (VALUES (4, 'c@x.org', TRUE), (6, 'd@x.org', TRUE), (3, 'A@X.org', FALSE), (5, 'C@x.org', FALSE)) t(a, b, c)",
    "session_ttl": f'{_SESSIONS} SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session',
    "stream_session_ttl": f"""{_SESSIONS}, g2 AS (SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session)
SELECT * FROM g2 WHERE "end" + INTERVAL 60 MINUTES <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""",
    "session_numbers": f"{_SESSIONS} SELECT event_id, user_id, session FROM s",
    "last_n_turns": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4",
    "chunk_cache": """WITH f AS (SELECT user_id AS session, CAST(floor(value) AS BIGINT) AS id, min(event_id) AS slot, max(event_id) AS last FROM events GROUP BY ALL)
SELECT session, id, slot, last FROM f QUALIFY row_number() OVER (PARTITION BY session ORDER BY slot DESC, id DESC) <= 20""",
    "citation_map": "SELECT user_id AS session, 'C ' || event_id % 13 AS citation, arg_max(CAST(floor(value) AS BIGINT), event_id) AS id FROM events GROUP BY 1, 2",
    "filter_carry": "SELECT user_id AS session, event_id AS seq, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_force FROM events",
    "rewrite_context": "WITH r AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn) AS context FROM r GROUP BY conv_id",
    "tree_depth": f"WITH {_TREE} SELECT CAST(tree_id AS BIGINT) AS tree_id, max(depth) AS depth, count(*) FILTER (node_type = 'leaf') AS leaves FROM t JOIN n USING (tree_id, node_id) GROUP BY 1",
    "tree_consensus": f"""WITH {_TREE}, g(question, tree_id, pos) AS (VALUES {_values(_GROUPS)}), s AS (SELECT tree_id, max(depth) AS depth, count(*) FILTER (node_type = 'leaf') AS leaves FROM t JOIN n USING (tree_id, node_id) GROUP BY 1),
  v AS (SELECT question, tree_id, pos, count(*) OVER w AS votes, min(pos) OVER w AS first FROM s JOIN g USING (tree_id) WINDOW w AS (PARTITION BY question, depth, leaves))
SELECT question, CAST(arg_min(tree_id, (-votes, first, pos)) AS BIGINT) AS tree_id FROM v GROUP BY question""",
    "tree_truncate": f"WITH {_TREE} SELECT CAST(tree_id AS BIGINT) AS tree_id, CAST(node_id AS BIGINT) AS node_id, CASE WHEN depth = 2 THEN 'leaf' ELSE node_type END AS node_type FROM t JOIN n USING (tree_id, node_id) WHERE depth <= 2",
    "retrieval_plan": f"""WITH {_TREE} SELECT CAST(tree_id AS BIGINT) AS tree_id, CAST(node_id AS BIGINT) AS node_id, query, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY path) AS INTEGER) AS n
FROM t JOIN n USING (tree_id, node_id) WHERE node_type = 'leaf' QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY path) <= 2""",
    "leaf_answers": _ANSWER,
    "level_checks": "SELECT CASE WHEN o_orderkey % 9 BETWEEN 1 AND 6 THEN 'L' || o_orderkey % 9 ELSE 'L2' END AS level, count(*) AS n FROM orders GROUP BY 1",
    "premise_corrections": "SELECT doc_id, CASE WHEN instr(text, '. ') BETWEEN 1 AND 199 THEN substr(text, 1, instr(text, '. ')) ELSE substr(text, 1, 200) END AS correction FROM documents WHERE doc_id % 10 >= 3",
    "weights_override": "SELECT a AS rel_type, CAST(b AS DOUBLE) AS weight FROM (VALUES ('IMPLEMENTS', 0.75), ('SUBJECT_TO', 0.70), ('DEFINED_BY', 0.65), ('AMENDED_BY', 0.60), ('CITES', 0.5), ('NEW', 1)) t(a, b)",
}
