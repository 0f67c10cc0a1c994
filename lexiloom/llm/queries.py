"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_digest

    return token_digest(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vafile import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without the removed lines, n_lines, n_removed."""
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_digest

    return license_digest(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import dedup_digest

    return dedup_digest(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_digest

    return pack_digest(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_mixing, op3_token_store, op4_exact_topk, op5_line_dedup, op6_licenses, op7_url_filter, op8_simhash_dedup, op9_quality_rules, op10_packing)
}
SQL = {
    "op2_mixing": r"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  t AS (SELECT source, CAST(sum(size) AS BIGINT) AS w, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s GROUP BY source),
  r AS (SELECT *, ([5, 2, 1])[k % 3 + 1] AS weight, CAST(sum(w) OVER () AS BIGINT) AS total FROM t),
  c AS (SELECT *, total - coalesce(sum(3 * w) OVER (ORDER BY 3 * w / weight::DOUBLE, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
          sum(weight) OVER (ORDER BY 3 * w / weight::DOUBLE, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM r),
  o AS (SELECT *, rest::DOUBLE * weight / weights::DOUBLE > 3 * w AS over FROM c),
  f AS (SELECT min_by(rest, 3 * w / weight::DOUBLE) AS rest, max(weights) AS weights FROM o WHERE NOT over),
  g AS (SELECT o.source, o.w, CASE WHEN o.over THEN 3.0 * o.w ELSE f.rest::DOUBLE * o.weight / f.weights::DOUBLE END::DOUBLE AS target FROM o, f),
  p AS (SELECT s.*, w, target, CAST(floor(target + 0.5) AS BIGINT) AS take, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, w AS source_size, target, CAST(coalesce(take // nullif(w, 0) * size + greatest(0, least(take % nullif(w, 0), a + size) - a), 0) AS BIGINT) AS taken FROM p""",
    "op4_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
}
