"""Score fusion of ranked lists ``(source, id, score)``, optionally by query_id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FUSION_WEIGHTS, RRF_K, RRF_WEIGHTS
from ..functions import lookup


def linear_fuse(lists: DataFrame, weights: Mapping[str, float] = FUSION_WEIGHTS, by: tuple[str, ...] = ()) -> DataFrame:
    """Min-max to [0, 1] in each source (a source without spread gives 1), weighted sum, sources kept.

    A source that lacks an id adds nothing; ties go to the smaller id."""
    own = Window.partitionBy(*by, "source")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
    rows = lists.withColumn("part", scaled * lookup(weights, F.col("source"), 0.0))
    return rows.groupBy(*by, "id").agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def rrf_fuse(lists: DataFrame, weights: Mapping[str, float] = RRF_WEIGHTS, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of weight / (k + rank); unknown sources weigh nothing, repeats in a list add again."""
    rank = F.row_number().over(Window.partitionBy(*by, "source").orderBy(F.desc("score"), "id"))
    rows = lists.withColumn("part", lookup(weights, F.col("source"), 0.0) / (k + rank))
    return rows.groupBy(*by, "id").agg(F.sum("part").alias("score"))


def top(rows: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best by score (ties by id), of each query if ``by`` names one."""
    if not by:
        return rows.orderBy(F.desc("score"), "id").limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def union_seeds(*lists: DataFrame) -> DataFrame:
    """Distinct ids in order of first appearance over lists of (id, pos)."""
    rows = None
    for n, one in enumerate(lists):
        one = one.select("id", F.struct(F.lit(n).alias("list"), F.col("pos").alias("pos")).alias("at"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("id").agg(F.min("at").alias("at")).select("id", "at.list", "at.pos")


def with_score(rows: DataFrame, distance: str | None = None, default: float = 0.5) -> DataFrame:
    """``score`` of search results: one less the distance, or the score they have; ``default`` where neither is there."""
    known = F.lit(1.0) - F.col(distance) if distance in rows.columns else F.col("score") if "score" in rows.columns else F.lit(None).cast("double")
    return rows.withColumn("score", F.coalesce(known, F.lit(default)))


def breakdown(lists: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """source, n, citation, agency, score (four places) of the ``k`` best of each ranked list(source, id, score)."""
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id"))
    best = lists.withColumn("n", n).where(F.col("n") <= k)
    return best.join(chunks.select("id", "citation", "agency"), "id", "left").select("source", "n", F.coalesce("citation", F.lit("")).alias("citation"), F.coalesce("agency", F.lit("")).alias("agency"), F.round("score", 4).alias("score"))
