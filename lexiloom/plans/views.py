"""The tables under the names that the operators use, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHORITY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'state_statute' WHEN '2-HIGH' THEN 'state_admin_rule' WHEN '3-MEDIUM' THEN 'court_opinion' WHEN '4-NOT SPECIFIED' THEN 'local_statute' ELSE 'guidance' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: source is the agency, lang the document type."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("agency"), F.col("lang").alias("document_type"))


def chunk_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("agency"))


def query_vec(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of id 0."""
    return list(chunk_vec(spark, sf_dir).where("id = 0").select("vector").first()[0])


def implements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> part edges with confidence."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return rows.agg(F.round(1 - F.min("l_discount"), 4).alias("confidence")).withColumn("rel_type", F.lit("IMPLEMENTS"))


IMPLEMENTS = "SELECT l_suppkey AS src, l_partkey AS dst, round(1 - min(l_discount), 4) AS confidence, 'IMPLEMENTS' AS rel_type FROM lineitem GROUP BY ALL"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order -> part edges: A cites, N is subject to, R is defined by."""
    kind = F.when(F.col("l_returnflag") == "A", "CITES").when(F.col("l_returnflag") == "N", "SUBJECT_TO").otherwise("DEFINED_BY")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), kind.alias("rel_type"))
    return rows.agg(F.round(1 - F.min("l_discount"), 4).alias("confidence"))


TYPED = "SELECT l_orderkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'CITES' WHEN 'N' THEN 'SUBJECT_TO' ELSE 'DEFINED_BY' END AS rel_type, round(1 - min(l_discount), 4) AS confidence FROM lineitem GROUP BY ALL"


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each (order, number), as chunks of a file: id order * 10 + number."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("filename"), F.col("l_linenumber").alias("chunk_index"))
    return rows.agg(F.min("l_partkey").alias("part")).withColumn("id", F.col("filename") * 10 + F.col("chunk_index"))


SEQUENCE = "SELECT l_orderkey AS filename, l_linenumber AS chunk_index, min(l_partkey) AS part, l_orderkey * 10 + l_linenumber AS id FROM lineitem GROUP BY ALL"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as results of their customers' queries: authority by priority, agency by customer's
    segment, score by price."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    n = F.floor(F.col("o_totalprice") * 7).cast("long") % 1000
    return rows.select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), (n / 1000.0).alias("score"), F.col("c_mktsegment").alias("agency0"),
        F.element_at(F.array(*map(F.lit, ("AA", "BB", "CC", "DD"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("agency"),
        F.expr(AUTHORITY_SQL).alias("authority_level"), F.concat(F.lit("C "), (F.col("o_orderkey") % 50).cast("string")).alias("citation"),
    ).drop("agency0")


RESULTS = f"""SELECT o_custkey AS query_id, o_orderkey AS id, (CAST(floor(o_totalprice * 7) AS BIGINT) % 1000) / 1000.0::DOUBLE AS score,
  (['AA', 'BB', 'CC', 'DD'])[o_orderkey % 4 + 1] AS agency, {AUTHORITY_SQL} AS authority_level, 'C ' || CAST(o_orderkey % 50 AS VARCHAR) AS citation
  FROM orders JOIN customer ON o_custkey = c_custkey"""
