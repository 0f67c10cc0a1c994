"""Queries of citations and graph operators, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EDGE_TYPES
from ..functions import cosine
from ..operators import citations, graph
from . import views
from .search_queries import _COS, _values

# ---- citations ---------------------------------------------------------------------------

_TEXTS = [
    (1, "WAC", "See RCW 36.70A.681 and RCW  36.70A.681, WAC 365-196-410(2)(a). [Statutory Authority: RCW 36.70A.050 and 36.70A.190, effective 1/1/2020]"),
    (2, "SMC", "This chapter is to implement chapter 43.21C RCW; subject to SMC 23.45.502. As defined in RCW 84.14.010, Section 23.45.502 applies."),
    (3, "Seattle DIR", "Code/Section Reference: SMC 23.54.015\nSupersedes: DR 10-2012\nper Director's Rule 31-2017, Ord. 123456"),
    (4, "RCW", "RCW 62A.9A-406, 62A.9A-407, and 62A.9A-408; required filings under RCW 19.27.031. Executive Order 24-01 rescinds EO 05-03."),
    (5, "SPU", "IBC Section 1607.1 and IBC 903; State v. Smith, 123 Wn.2d 456; WASH. CONST. art. XI, section 11; chapters 36.70A and 43.21C RCW"),
    (6, "RCW", "no citation"),
]


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_TEXTS, "id long, agency string, text string")
    return rows.select("id", F.posexplode(citations.extract(F.col("text"))).alias("pos", "citation"))


_RE2 = [p.replace("'", "''") for p in citations.PATTERNS.values()]
_EXTRACT = f"""WITH t(id, agency, text) AS (VALUES {_values(_TEXTS)}),
  f AS (SELECT CAST(id AS BIGINT) AS id, list_concat({", ".join(f"regexp_extract_all(text, '{p}')" for p in _RE2)},
          flatten(list_transform(regexp_extract_all(text, '{citations.RCW_LIST}', 1), lambda x: list_transform(regexp_extract_all(x, '{citations._LISTED}'), lambda n: 'RCW ' || n)))) AS c FROM t),
  u AS (SELECT id, unnest(c) AS citation, generate_subscripts(c, 1) AS k FROM f), g AS (SELECT id, citation, min(k) AS k FROM u GROUP BY ALL)
SELECT id, citation, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS pos FROM g"""


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Parts as chunks with citations of three kinds."""
    p = F.col("p_partkey")
    wac = F.format_string("WAC %d-%d-%d", 100 + p % 40, 10 + p % 9, 100 + p % 300)
    rcw = F.format_string("RCW %d.%dA.%d", 10 + p % 50, 10 + p % 7, 100 + p % 300)
    smc = F.format_string("SMC %d.%d.%d", 20 + p % 5, 10 + p % 80, 100 + p % 300)
    cite = F.when(p % 10 == 9, F.lit(" ")).when(p % 3 == 0, wac).when(p % 3 == 1, rcw).otherwise(smc)
    return views.table(spark, d, "part").select(p.alias("id"), cite.alias("citation"), p.alias("ord"))


_PARTS = """p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 9 THEN ' ' WHEN p_partkey % 3 = 0 THEN format('WAC {}-{}-{}', 100 + p_partkey % 40, 10 + p_partkey % 9, 100 + p_partkey % 300)
    WHEN p_partkey % 3 = 1 THEN format('RCW {}.{}A.{}', 10 + p_partkey % 50, 10 + p_partkey % 7, 100 + p_partkey % 300) ELSE format('SMC {}.{}.{}', 20 + p_partkey % 5, 10 + p_partkey % 80, 100 + p_partkey % 300) END AS citation FROM part),
  ex AS (SELECT citation AS key, max(id) AS target FROM p WHERE trim(citation) <> '' GROUP BY 1),
  ch AS (SELECT CASE WHEN citation LIKE 'WAC%' THEN regexp_replace(citation, '-[^-]*$', '') ELSE regexp_replace(citation, '\\.[^.]*$', '') END AS key, min(id) AS target FROM p WHERE trim(citation) <> '' GROUP BY 1)"""


def citation_index(spark: SparkSession, d: str) -> DataFrame:
    exact, chapters = citations.index(_numbered(spark, d))
    return exact.select(F.lit("exact").alias("kind"), F.col("citation").alias("key"), "target").union(chapters.select(F.lit("chapter"), "chapter", "target"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Every order's reference to a part: as it is cited, spaced, with groups, as a bare section or chapter."""
    o = F.col("o_orderkey")
    rows = views.table(spark, d, "orders").select(o.alias("source"), (o % 2500 + 1).alias("id")).join(_numbered(spark, d).select("id", "citation"), "id", "left")
    c = F.coalesce("citation", F.lit("RCW 99.99.999"))
    kind = F.col("source") % 6
    form = F.when(kind == 0, c).when(kind == 1, F.regexp_replace(F.concat(F.lit("  "), c, F.lit(" ")), " ", "  ")).when(kind == 2, F.concat(c, F.lit("(a)(1)"))).when(kind == 3, F.regexp_replace(c, "^SMC ", "Section ")).when(kind == 4, F.regexp_replace(c, r"[.-][^.-]*$", "")).otherwise(F.regexp_replace(c, r"[.-][^.-]*$", ".777"))
    return rows.select("source", form.alias("citation"))


_REFS = r"""r AS (SELECT o_orderkey AS source, coalesce(citation, 'RCW 99.99.999') AS c FROM orders LEFT JOIN p ON p.id = o_orderkey % 2500 + 1),
  f AS (SELECT source, CASE source % 6 WHEN 0 THEN c WHEN 1 THEN replace('  ' || c || ' ', ' ', '  ') WHEN 2 THEN c || '(a)(1)' WHEN 3 THEN regexp_replace(c, '^SMC ', 'Section ')
    WHEN 4 THEN regexp_replace(c, '[.-][^.-]*$', '') ELSE regexp_replace(c, '[.-][^.-]*$', '.777') END AS citation FROM r),
  n AS (SELECT source, citation, trim(regexp_replace(citation, '\s+', ' ', 'g')) AS c FROM f),
  k AS (SELECT *, CASE WHEN c LIKE 'Section %' THEN 'SMC ' || c[9:] END AS smc, split_part(c, ' ', 1) AS code, CASE WHEN contains(c, ' ') THEN regexp_replace(c, '^\S+ ', '') END AS num FROM n),
  s AS (SELECT *, coalesce(CASE WHEN upper(code) = 'WAC' THEN len(string_split(num, '-')) >= 3 ELSE contains(num, '.') AND (len(string_split(num, '.')) >= 3 OR contains(num, '-')) END, FALSE) AS sec,
    CASE WHEN upper(code) = 'WAC' AND contains(num, '-') THEN code || ' ' || regexp_replace(num, '-[^-]*$', '') WHEN contains(num, '.') THEN code || ' ' || regexp_replace(num, '\.[^.]*$', '') END AS chap FROM k),
  cand AS (SELECT source, citation, c AS key, FALSE AS chapter, 0 AS prio FROM s
    UNION ALL SELECT source, citation, regexp_replace(c, '\([a-z0-9]+\)$', ''), FALSE, 1 FROM s
    UNION ALL SELECT source, citation, regexp_replace(c, '\([a-z0-9]+\)\([a-z0-9]+\)$', ''), FALSE, 2 FROM s
    UNION ALL SELECT source, citation, smc, FALSE, 100 FROM s WHERE smc IS NOT NULL
    UNION ALL SELECT source, citation, c, TRUE, 200 FROM s WHERE NOT sec UNION ALL SELECT source, citation, chap, TRUE, 201 FROM s WHERE NOT sec),
  hit AS (SELECT source, citation, prio, target FROM cand JOIN ex USING (key) WHERE NOT chapter UNION ALL SELECT source, citation, prio, target FROM cand JOIN ch USING (key) WHERE chapter),
  best AS (SELECT source, arg_min(target, prio) AS target FROM hit GROUP BY source)"""


def citation_resolve(spark: SparkSession, d: str) -> DataFrame:
    exact, chapters = citations.index(_numbered(spark, d))
    return citations.resolve(_references(spark, d), exact, chapters).select("source", F.trim("citation").alias("citation"), "target")


_CITED = [("WAC 365-196-410",), ("WAC 365-196",), ("RCW 36.70A.681",), ("RCW 62A.9A-709",), ("RCW 76.09",), ("  SMC  23.45.502(A) ",), ("ordinance",), ("Section 23.45.502",)]


def citation_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_CITED, "raw string")
    c = F.col("raw")
    return rows.select("raw", citations.normalize(c).alias("citation"), citations.chapter_of(c).alias("chapter"), citations.is_section(c).alias("section"))


_NORMALIZE = rf"""WITH t(raw) AS (VALUES {_values(_CITED)}), n AS (SELECT raw, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS c FROM t),
  k AS (SELECT *, split_part(c, ' ', 1) AS code, CASE WHEN contains(c, ' ') THEN regexp_replace(c, '^\S+ ', '') END AS num FROM n)
SELECT raw, c AS citation, CASE WHEN code = 'WAC' AND contains(num, '-') THEN code || ' ' || regexp_replace(num, '-[^-]*$', '') WHEN contains(num, '.') THEN code || ' ' || regexp_replace(num, '\.[^.]*$', '') END AS chapter,
  coalesce(CASE WHEN code = 'WAC' THEN len(string_split(num, '-')) >= 3 ELSE contains(num, '.') AND (len(string_split(num, '.')) >= 3 OR contains(num, '-')) END, FALSE) AS section FROM k"""


def relationship_extract(spark: SparkSession, d: str) -> DataFrame:
    return citations.relations(spark.createDataFrame(_TEXTS, "id long, agency string, text string")).select("source", "rel_type", "citation")


# what a reader finds in _TEXTS
_RELATIONS = [
    (1, "IMPLEMENTS", "RCW 36.70A.050"), (1, "CITES", "RCW 36.70A.681"), (1, "CITES", "WAC 365-196-410(2)(a)"), (2, "CITES", "chapter 43.21C RCW"), (2, "IMPLEMENTS", "RCW 43.21C"),
    (2, "SUBJECT_TO", "SMC 23.45.502"), (2, "IMPLEMENTS", "RCW 84.14.010"), (2, "CITES", "Section 23.45.502"), (3, "IMPLEMENTS", "SMC 23.54.015"), (3, "AMENDED_BY", "DR 10-2012"),
    (3, "CITES", "Director's Rule 31-2017"), (3, "CITES", "Ord. 123456"), (4, "CITES", "RCW 62A.9A-406"), (4, "CITES", "RCW 62A.9A-407"), (4, "CITES", "RCW 62A.9A-408"), (4, "SUBJECT_TO", "RCW 19.27.031"),
    (4, "CITES", "Executive Order 24-01"), (4, "AMENDED_BY", "EO 05-03"), (5, "CITES", "IBC Section 1607.1"), (5, "CITES", "IBC 903"), (5, "CITES", "State v. Smith, 123 Wn.2d 456"), (5, "CITES", "WASH. CONST. art. XI, section 11"),
]


def relationship_resolve(spark: SparkSession, d: str) -> DataFrame:
    """References of all orders split into edges and unresolved ones, counted by kind."""
    exact, chapters = citations.index(_numbered(spark, d))
    refs = _references(spark, d).withColumn("rel_type", F.when(F.col("source") % 2 == 0, "CITES").otherwise("SUBJECT_TO"))
    edges, left = citations.split_resolved(refs, exact, chapters)
    out = edges.groupBy("rel_type").agg(F.count("*").alias("n"), F.sum("dst").alias("targets")).withColumn("kind", F.lit("edge"))
    return out.unionByName(left.groupBy("rel_type").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("targets")).withColumn("kind", F.lit("unresolved")))


_BARE = [("Section 23.50.012 D", "SMC"), ("365-196-401", "WAC"), ("RCW 36.70A.681", "SMC"), ("Chapter 36.70A", "RCW"), ("31-2017", "Seattle DIR"), ("Section 5", "Unknown"), ("subsection 3", "ibc-wa"), ("Title 9", "RCW")]


def prefix_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_BARE, "raw string, agency string")
    return rows.select("raw", "agency", citations.with_prefix(F.col("raw"), F.col("agency")).alias("citation"))


_PREFIX = rf"""WITH t(raw, agency) AS (VALUES {_values(_BARE)}), m AS (SELECT *, CASE upper(trim(agency)) WHEN 'RCW' THEN 'RCW' WHEN 'WAC' THEN 'WAC' WHEN 'SMC' THEN 'SMC' WHEN 'IBC' THEN 'IBC' WHEN 'IBC-WA' THEN 'IBC' WHEN 'DIR' THEN 'DIR' WHEN 'SEATTLE DIR' THEN 'DIR' WHEN 'SPU' THEN 'SPU' END AS p FROM t)
SELECT raw, agency, CASE WHEN p IS NULL OR regexp_matches(trim(raw), '(?i)^(RCW|WAC|SMC|IBC|DIR|SPU) ') THEN raw WHEN regexp_matches(raw, '(?i)^(Section|Subsection|Chapter)\s+') THEN p || ' ' || regexp_replace(raw, '(?i)^(Section|Subsection|Chapter)\s+', '')
  WHEN regexp_matches(trim(raw), '^[^A-Za-z]') THEN p || ' ' || trim(raw) ELSE raw END AS citation FROM m"""


def priority_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = views.typed(spark, d).select(F.col("src").alias("source"), F.col("dst").cast("string").alias("citation"), "rel_type")
    return citations.strongest(rows).groupBy("rel_type").agg(F.count("*").alias("n"), F.sum("source").alias("sources"))


_PROPOSED = [(1, "RCW 36.70A.681", "CITES"), (1, "rcw 36.70a.681", "SUBJECT_TO"), (1, "RCW 1.2.3", "CITES"), (4, "62A.9A-407", "CITES"), (5, "RCW 43.21C", "IMPLEMENTS"), (6, "WAC 1-2-3", "CITES"), (2, "SMC 23.45.502", "CITES")]


def proposals_grounded(spark: SparkSession, d: str) -> DataFrame:
    chunks = spark.createDataFrame([(i, t, "SMC 23.45.502" if i == 2 else None) for i, _, t in _TEXTS], "id long, text string, citation string")
    return citations.grounded(spark.createDataFrame(_PROPOSED, "id long, citation string, rel_type string"), chunks).select("source", "citation", "rel_type")


_GROUNDED = [(1, "RCW 36.70A.681", "CITES"), (1, "rcw 36.70a.681", "SUBJECT_TO"), (4, "62A.9A-407", "CITES"), (5, "RCW 43.21C", "IMPLEMENTS")]

# ---- graph -------------------------------------------------------------------------------


def next_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.next_edges(views.sequence(spark, d)).select("src", "dst")


def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lines as chunks, orders as files, return flags as agencies."""
    chunks = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("filename"), F.col("l_linenumber").alias("chunk_index"))
    chunks = chunks.agg(F.min("l_returnflag").alias("agency")).withColumn("id", F.col("filename") * 10 + F.col("chunk_index")).withColumn("authority_level", F.lit("guidance"))
    agencies, docs, edges = graph.hierarchy(chunks)
    return edges.groupBy("rel_type", F.when(F.col("rel_type") == "AGENCY_HAS_DOC", F.col("parent")).otherwise("*").alias("parent")).agg(F.count("*").alias("n"), F.sum(F.col("child").cast("long")).alias("children"))


def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_counts(views.typed(spark, d).unionByName(views.implements(spark, d)))


def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(views.typed(spark, d))


def _seeds(spark: SparkSession, ids: range) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


_SUPPLY = "SELECT l_suppkey AS src, 100000000 + l_partkey AS dst, round(1 - min(l_discount), 4) AS confidence, 'IMPLEMENTS' AS rel_type FROM lineitem GROUP BY ALL"


def _supply(spark: SparkSession, d: str) -> DataFrame:
    return views.implements(spark, d).withColumn("dst", F.col("dst") + 100_000_000)


def bfs_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hops(_supply(spark, d), _seeds(spark, range(1, 4)))


_BFS = f"""WITH e AS ({_SUPPLY}), b AS (SELECT src AS a, dst AS b, confidence, TRUE AS o FROM e UNION ALL SELECT dst, src, confidence, FALSE FROM e),
  h AS (SELECT b.b, max(confidence) AS confidence, o FROM b WHERE a IN (1, 2, 3) GROUP BY b.b, o),
  t AS (SELECT b AS id, 1 AS depth, confidence FROM h UNION ALL SELECT y.b, 2, y.confidence FROM h JOIN b y ON h.b = y.a AND h.o = y.o)
SELECT id, min(depth) AS depth, 'IMPLEMENTS' AS rel_type, arg_min(confidence, (depth, -confidence)) AS confidence FROM t WHERE id NOT IN (1, 2, 3) GROUP BY id ORDER BY depth, confidence DESC, id LIMIT 50"""


def node_context(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.table(spark, d, "part").select((F.col("p_partkey") + 100_000_000).alias("id"), F.col("p_name").alias("citation"))
    return graph.node_context(_supply(spark, d), nodes, _seeds(spark, range(1, 6)))


def relationship_panel(spark: SparkSession, d: str) -> DataFrame:
    edges = views.typed(spark, d).withColumn("dst", F.col("dst") + 100_000_000)
    nodes = views.table(spark, d, "part").select((F.col("p_partkey") + 100_000_000).alias("id"), F.col("p_name").alias("citation"))
    ids = views.table(spark, d, "part").select((F.col("p_partkey") + 100_000_000).alias("id")).union(views.table(spark, d, "orders").select("o_orderkey"))
    return graph.relationship_panel(edges, nodes, ids)


_PANEL = f"""WITH e AS (SELECT src, dst + 100000000 AS dst, rel_type FROM ({views.TYPED})),
  c AS (SELECT src AS id, dst AS other, CASE rel_type WHEN 'SUBJECT_TO' THEN 'subject_to' ELSE 'cites' END AS panel FROM e
        UNION SELECT dst, src, 'cited_by' FROM e WHERE rel_type = 'CITES')
SELECT id, panel, other, CAST(row_number() OVER (PARTITION BY id, panel ORDER BY other) AS INTEGER) AS n FROM c QUALIFY n <= 5"""

_VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT count(*) AS m FROM embeddings)"


def _node_vectors(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    """Targets' vectors: the embedding of id modulo the number of embeddings."""
    v = views.chunk_vec(spark, d)
    m = v.count()
    ids = edges.select(F.col("dst").alias("id")).distinct()
    return ids.join(v.select(F.col("id").alias("vid"), "vector"), F.col("id") % m == F.col("vid")).select("id", "vector")


def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    edges = views.typed(spark, d).withColumn("dst", F.col("dst") + 100_000_000)
    rows = graph.expand(edges, _node_vectors(spark, d, edges), _seeds(spark, range(1, 8)), views.query_vec(spark, d))
    return rows.select("id", F.round("score", 6).alias("score"), "rel_type")


_EXPAND = f"""WITH {_VEC}, q AS (SELECT v AS qv FROM v WHERE id = 0), e AS (SELECT src, dst + 100000000 AS dst, rel_type, confidence FROM ({views.TYPED}) WHERE src BETWEEN 1 AND 7),
  n AS (SELECT *, CASE rel_type WHEN 'CITES' THEN 0.35 WHEN 'SUBJECT_TO' THEN 0.70 ELSE 0.65 END::DOUBLE AS w FROM e QUALIFY row_number() OVER (PARTITION BY src, rel_type ORDER BY confidence DESC, dst) <= 3),
  b AS (SELECT dst AS id, max(w) AS w, arg_max(rel_type, w) AS rel_type FROM n GROUP BY dst)
SELECT b.id, round(list_dot_product(v.v, qv) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(qv, qv))) * w, 6) AS score, rel_type FROM b, m, q JOIN v ON v.id = b.id % m
ORDER BY list_dot_product(v.v, qv) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(qv, qv))) * w DESC, b.id LIMIT 10"""


def beam_traverse(spark: SparkSession, d: str) -> DataFrame:
    """From ten suppliers to parts, and from parts to the supplier of the same number, three hops deep."""
    edges = _two_way(spark, d)
    rows = graph.beam(edges, _node_vectors(spark, d, edges), _seeds(spark, range(1, 11)), views.query_vec(spark, d), "authority_chain")
    return rows.select("id", F.round("score", 6).alias("score"), "depth", "rel_type")


def _two_way(spark: SparkSession, d: str) -> DataFrame:
    back = views.implements(spark, d).select((F.col("dst") + 100_000_000).alias("src"), F.col("src").alias("dst"), "confidence", F.lit("SUBJECT_TO").alias("rel_type"))
    return _supply(spark, d).unionByName(back)


def _beam_sql() -> str:
    hops = ""
    for h, decay in ((1, 1.0), (2, 0.7), (3, 0.45)):
        front = "SELECT unnest(range(1, 11)) AS id" if h == 1 else f"SELECT id FROM h{h - 1}"
        hops += f""", c{h} AS (SELECT dst AS id, max(w) AS w, arg_max(rel_type, w) AS rel_type FROM e WHERE src IN ({front}) AND dst NOT BETWEEN 1 AND 10 GROUP BY dst),
  h{h} AS (SELECT c{h}.id, round(cos * w * {decay}::DOUBLE / (1 + ln(1 + coalesce(n, 0))), 9) AS score, {h} AS depth, rel_type FROM c{h} JOIN cv ON cv.id = c{h}.id LEFT JOIN deg ON deg.id = c{h}.id ORDER BY score DESC, c{h}.id LIMIT 10)"""
    return f"""WITH {_VEC}, q AS (SELECT v AS qv FROM v WHERE id = 0), s AS ({_SUPPLY}),
  e AS (SELECT src, dst, rel_type, 1.125::DOUBLE AS w FROM s UNION ALL SELECT dst, src, 'SUBJECT_TO', 0.7::DOUBLE FROM s),
  deg AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY dst),
  cv AS (SELECT deg.id, list_dot_product(v.v, qv) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(qv, qv))) AS cos FROM deg, m, q JOIN v ON v.id = deg.id % m){hops},
  a AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)
SELECT id, round(max(score), 6) AS score, arg_min(depth, (-score, depth)) AS depth, arg_min(rel_type, (-score, depth)) AS rel_type FROM a GROUP BY id"""


def next_chain_expand(spark: SparkSession, d: str) -> DataFrame:
    """From line 3 of the first 200 orders; a line's vector is that of its part modulo the embeddings."""
    seq = views.sequence(spark, d)
    v = views.chunk_vec(spark, d)
    m = v.count()
    query = views.query_vec(spark, d)
    # one cosine a vector, not one a line that has it
    near = v.select(F.col("id").alias("vid"), cosine(F.col("vector"), F.array(*map(F.lit, query))).alias("score"))
    scores = seq.join(near, F.col("part") % m == F.col("vid")).select("id", "score")
    seeds = seq.where("chunk_index = 3").select("id")
    return graph.next_chain(seq, scores, seeds, query, threshold=-0.05).select("id", "seed", "hop", F.round("score", 6).alias("score"))


_CHAIN = f"""WITH {_VEC}, q AS (SELECT v AS qv FROM v WHERE id = 0), s AS ({views.SEQUENCE}),
  c AS (SELECT s.*, list_dot_product(v.v, qv) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(qv, qv))) AS score FROM s, m, q JOIN v ON v.id = s.part % m),
  r AS (SELECT s.id AS seed, s.filename, h.hop, s.chunk_index + h.hop AS k FROM s, (SELECT unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS hop) h WHERE s.chunk_index = 3),
  j AS (SELECT r.seed, r.hop, c.id, c.score, max(CASE WHEN c.score >= -0.05::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY r.seed, r.hop > 0 ORDER BY abs(r.hop)) AS ended FROM r LEFT JOIN c ON c.filename = r.filename AND c.chunk_index = r.k)
SELECT id, seed, CAST(hop AS INTEGER) AS hop, round(score, 6) AS score FROM j WHERE ended = 0"""

_KEYS = [("WAC",), ("court_opinion",), (None,), (" ",), ("unknown",), ("Governor Orders",), ("court",), ("ibc-wa",)]


def doctype_threshold(spark: SparkSession, d: str) -> DataFrame:
    return graph.threshold_for(spark.createDataFrame(_KEYS, "key string"), graph.NEXT_THRESHOLDS)


def seed_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Labels as leaves, vectors ranked by id."""
    from pyspark.sql import Window

    v = views.table(spark, d, "embeddings")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    leaves = v.select(F.col("label").alias("leaf"), rank.alias("rank"), F.col("vec_id").alias("id"))
    seeds, mean = graph.fuse_seeds(leaves, views.chunk_vec(spark, d))
    return mean.select(F.posexplode("vector").alias("d", "x")).select("d", F.round("x", 6).alias("x"))


def shared_authority(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("agency"))
    return graph.shared_authority(views.implements(spark, d), nodes, _seeds(spark, range(1, 4)))


def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of different nations with a part of confidence 0.995 or more in common."""
    nodes = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("agency"))
    return graph.conflict_pairs(views.implements(spark, d).where("confidence >= 0.995"), nodes)


def cross_agency_knn(spark: SparkSession, d: str) -> DataFrame:
    return graph.cross_agency(views.chunk_vec(spark, d), _seeds(spark, range(0, 20)), least=0.2).select("id", "seed", F.round("score", 6).alias("score"))


_CROSS = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
  p AS (SELECT a.id AS seed, b.id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS score FROM v a JOIN v b ON a.label <> b.label WHERE a.id < 20)
SELECT id, seed, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(score, 12) DESC, id) <= 3 AND p.score >= 0.2::DOUBLE"""


def conflict_expand(spark: SparkSession, d: str) -> DataFrame:
    v = views.chunk_vec(spark, d)
    rows = graph.conflict_expand(views.implements(spark, d), v.select("id", "agency"), v, _seeds(spark, range(1, 4)), views.query_vec(spark, d), least=0.2)
    return rows.select("id", "tag", F.round("score", 6).alias("score"))


_CONFLICT = f"""WITH {_COS}, e AS ({views.IMPLEMENTS}),
  a AS (SELECT DISTINCT y.src AS id FROM e x JOIN e y USING (dst) JOIN embeddings p ON p.vec_id = x.src JOIN embeddings r ON r.vec_id = y.src WHERE x.src BETWEEN 1 AND 3 AND y.src NOT BETWEEN 1 AND 3 AND p.label <> r.label),
  k AS (SELECT a.id AS seed, b.id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS score FROM vec a JOIN vec b ON a.agency <> b.agency WHERE a.id BETWEEN 1 AND 3),
  n AS (SELECT DISTINCT id FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(score, 12) DESC, id) <= 3) WHERE score >= 0.2::DOUBLE AND id NOT BETWEEN 1 AND 3),
  u AS (SELECT coalesce(a.id, n.id) AS id, CASE WHEN a.id IS NOT NULL AND n.id IS NOT NULL THEN 'shared_authority+cross_agency' WHEN a.id IS NOT NULL THEN 'shared_authority' ELSE 'cross_agency' END AS tag FROM a FULL JOIN n ON a.id = n.id)
SELECT u.id, tag, round(score, 6) AS score FROM u JOIN cos USING (id) ORDER BY cos.score DESC, u.id LIMIT 5"""


def expand_document(spark: SparkSession, d: str) -> DataFrame:
    """Customer 1 as document, orders as chunks, edges from an order to the one whose key is its part."""
    chunks = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("filename"))
    inside, pending = graph.expand_document(views.typed(spark, d), chunks, 1, [2, 3, 5, 7, 11])
    return inside.select(F.lit("edge").alias("kind"), "src", "dst", "rel_type", F.lit(1).cast("long").alias("n")).union(pending.select(F.lit("pending"), F.lit(0).cast("long"), "target", "rel_type", "n"))


_DOCUMENT = f"""WITH e AS ({views.TYPED}), x AS (SELECT e.src, e.dst, e.rel_type, t.o_custkey AS target FROM e JOIN orders s ON s.o_orderkey = src JOIN orders t ON t.o_orderkey = dst WHERE s.o_custkey = 1 AND t.o_custkey <> 1)
SELECT 'edge' AS kind, src, dst, rel_type, 1::BIGINT AS n FROM x WHERE target IN (2, 3, 5, 7, 11) UNION ALL SELECT 'pending', 0, target, rel_type, count(*) FROM x WHERE target NOT IN (2, 3, 5, 7, 11) GROUP BY ALL"""


def cross_doc_edges(spark: SparkSession, d: str) -> DataFrame:
    chunks = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("filename"))
    return graph.cross_document(views.typed(spark, d), chunks, 1, 2)


def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.neighbourhood(_supply(spark, d), _seeds(spark, range(1, 3)))
    return rows.groupBy("hop").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_NEAR = f"""WITH e AS ({_SUPPLY}), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), o AS (SELECT DISTINCT b AS id FROM b WHERE a IN (1, 2)), t AS (SELECT DISTINCT b.b AS id FROM b JOIN o ON o.id = b.a),
  r AS (SELECT unnest([1, 2]) AS id, 0 AS hop UNION ALL SELECT id, 1 FROM o UNION ALL SELECT id, 2 FROM t), g AS (SELECT id, min(hop) AS hop FROM r GROUP BY id)
SELECT hop, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM g GROUP BY hop"""


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return graph.missing_ids(ids, views.chunk_vec(spark, d).where("id % 2 = 0"))


def edge_styles(spark: SparkSession, d: str) -> DataFrame:
    return graph.styled(views.typed(spark, d)).groupBy("rel_type", "style").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        citation_extract, citation_index, citation_resolve, citation_normalize, relationship_extract, relationship_resolve, prefix_expand, priority_dedup, proposals_grounded,
        next_edges, hierarchy_edges, edge_counts, in_degree, bfs_two_hop, node_context, relationship_panel, graph_expand, beam_traverse, next_chain_expand, doctype_threshold,
        seed_fusion, shared_authority, conflict_pairs, cross_agency_knn, conflict_expand, expand_document, cross_doc_edges, neighbourhood, missing_ids, edge_styles,
    )
}

SQL = {
    "citation_extract": _EXTRACT,
    "citation_index": f"WITH {_PARTS} SELECT 'exact' AS kind, key, target FROM ex UNION ALL SELECT 'chapter', key, target FROM ch",
    "citation_resolve": f"WITH {_PARTS}, {_REFS} SELECT source, trim(citation) AS citation, target FROM n LEFT JOIN best USING (source)",
    "citation_normalize": _NORMALIZE,
    "relationship_extract": f"SELECT CAST(a AS BIGINT) AS source, b AS rel_type, c AS citation FROM (VALUES {_values(_RELATIONS)}) t(a, b, c)",
    "relationship_resolve": f"""WITH {_PARTS}, {_REFS}, t AS (SELECT source, citation, target, CASE WHEN source % 2 = 0 THEN 'CITES' ELSE 'SUBJECT_TO' END AS rel_type FROM n LEFT JOIN best USING (source))
SELECT rel_type, count(*) AS n, CAST(sum(target) AS BIGINT) AS targets, 'edge' AS kind FROM t WHERE target <> source GROUP BY rel_type UNION ALL SELECT rel_type, count(*), 0, 'unresolved' FROM t WHERE target IS NULL GROUP BY rel_type""",
    "prefix_expand": _PREFIX,
    "priority_dedup": f"""WITH e AS ({views.TYPED}), b AS (SELECT src, dst, arg_min(rel_type, CASE rel_type WHEN 'SUBJECT_TO' THEN 1 WHEN 'DEFINED_BY' THEN 2 ELSE 4 END) AS rel_type FROM e GROUP BY ALL)
SELECT rel_type, count(*) AS n, CAST(sum(src) AS BIGINT) AS sources FROM b GROUP BY rel_type""",
    "proposals_grounded": f"SELECT CAST(a AS BIGINT) AS source, b AS citation, c AS rel_type FROM (VALUES {_values(_GROUNDED)}) t(a, b, c)",
    "next_edges": f"WITH s AS ({views.SEQUENCE}) SELECT a.id AS src, b.id AS dst FROM s a JOIN s b ON a.filename = b.filename AND b.chunk_index = a.chunk_index + 1",
    "hierarchy_edges": """WITH c AS (SELECT l_orderkey AS filename, l_linenumber AS k, min(l_returnflag) AS agency FROM lineitem GROUP BY ALL), f AS (SELECT filename, arg_min(agency, k) AS agency FROM c GROUP BY filename)
SELECT 'AGENCY_HAS_DOC' AS rel_type, agency AS parent, count(*) AS n, CAST(sum(filename) AS BIGINT) AS children FROM f GROUP BY agency UNION ALL SELECT 'DOC_HAS_CHUNK', '*', count(*), CAST(sum(filename * 10 + k) AS BIGINT) FROM c""",
    "edge_counts": f"""WITH t(rel_type) AS (VALUES {_values([(t,) for t in EDGE_TYPES])}), e AS (SELECT rel_type FROM ({views.TYPED}) UNION ALL SELECT rel_type FROM ({views.IMPLEMENTS}))
SELECT t.rel_type, count(e.rel_type) AS n FROM t LEFT JOIN e USING (rel_type) GROUP BY t.rel_type""",
    "in_degree": f"SELECT dst AS id, count(*) AS in_degree FROM ({views.TYPED}) GROUP BY dst",
    "bfs_two_hop": _BFS,
    "node_context": f"SELECT e.src AS id, e.dst AS other, p_name AS citation, 'IMPLEMENTS' AS rel_type, 'out' AS direction FROM ({_SUPPLY}) e LEFT JOIN part ON p_partkey = dst - 100000000 WHERE src BETWEEN 1 AND 5",
    "relationship_panel": _PANEL,
    "graph_expand": _EXPAND,
    "beam_traverse": _beam_sql(),
    "next_chain_expand": _CHAIN,
    "doctype_threshold": f"""SELECT key, CASE WHEN trim(key) = '' OR key IS NULL THEN 0.35 WHEN lower(trim(key)) LIKE 'court%' THEN 0.25 WHEN lower(trim(key)) LIKE 'governor%' THEN 0.30 WHEN lower(trim(key)) LIKE 'ibc%' THEN 0.40
  WHEN lower(trim(key)) LIKE 'wac%' OR lower(trim(key)) LIKE 'rcw%' OR lower(trim(key)) LIKE 'smc%' THEN 0.50 ELSE 0.35 END::DOUBLE AS threshold FROM (VALUES {_values(_KEYS)}) t(key)""",
    "seed_fusion": """WITH s AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3),
  u AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM s), m AS (SELECT d, avg(x) AS x FROM u GROUP BY d)
SELECT CAST(d AS INTEGER) AS d, round(x / sqrt((SELECT sum(x * x) FROM m)), 6) AS x FROM m""",
    "shared_authority": f"""WITH e AS ({views.IMPLEMENTS}), m AS (SELECT y.src AS id, x.src AS seed, x.dst AS via FROM e x JOIN e y USING (dst) JOIN supplier a ON a.s_suppkey = x.src JOIN supplier b ON b.s_suppkey = y.src
  WHERE x.src BETWEEN 1 AND 3 AND y.src NOT BETWEEN 1 AND 3 AND a.s_nationkey <> b.s_nationkey)
SELECT id, min(seed) AS seed, arg_min(via, (seed, via)) AS via FROM m GROUP BY id""",
    "conflict_pairs": f"""WITH e AS (SELECT src, dst, s_nationkey AS nk FROM ({views.IMPLEMENTS}) JOIN supplier ON s_suppkey = src WHERE confidence >= 0.995::DOUBLE)
SELECT DISTINCT least(x.src, y.src) AS a, greatest(x.src, y.src) AS b FROM e x JOIN e y ON x.dst = y.dst AND x.nk < y.nk""",
    "cross_agency_knn": _CROSS,
    "conflict_expand": _CONFLICT,
    "expand_document": _DOCUMENT,
    "cross_doc_edges": f"""SELECT DISTINCT src, dst, rel_type FROM ({views.TYPED}) JOIN orders s ON s.o_orderkey = src JOIN orders t ON t.o_orderkey = dst
WHERE s.o_custkey % 25 IN (1, 2) AND t.o_custkey % 25 IN (1, 2) AND s.o_custkey % 25 <> t.o_custkey % 25""",
    "neighbourhood": _NEAR,
    "missing_ids": "SELECT doc_id AS id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5) ANTI JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) e ON e.vec_id = doc_id",
    "edge_styles": f"SELECT rel_type, CASE rel_type WHEN 'CITES' THEN 'solid' WHEN 'SUBJECT_TO' THEN 'dashed' ELSE 'dotted' END AS style, count(*) AS n FROM ({views.TYPED}) GROUP BY ALL",
}
