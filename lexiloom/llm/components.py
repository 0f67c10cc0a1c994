"""Connected components of links between 64-bit ids, distributed.

Alternating large-star and small-star rounds; every round's links are written
to the shared folder and read back.  Links stay at most one a node and round,
stars shrink to depth one in about log rounds, and nothing but two numbers a
round (count and checksum of the links) goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _with_least(rows: DataFrame, low: DataFrame, often: int) -> DataFrame:
    """rows(u, v) with m of their u from low(u, m, n).  Centres of over ``often`` links (so that there are
    at most some thousands of them, whatever the number of links) are broadcast, as one would fill a task."""
    hot = F.broadcast(low.where(F.col("n") > often).select("u", F.col("m").alias("hot")))
    seen = rows.join(hot, "u", "left")
    rest = seen.where("hot IS NULL").select("u", "v").join(low.where(F.col("n") <= often).select("u", "m"), "u")
    return seen.where("hot IS NOT NULL").select("u", "v", F.col("hot").alias("m")).union(rest.select("u", "v", "m"))


def _large_star(links: DataFrame, often: int) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), low, often).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame, often: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, low, often).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links(a, b)``: root is the smallest id reachable.

    Loops and repeated links are allowed; no links give no rows."""
    links = save(links.where("a <> b").distinct(), "links")
    before, total = None, links.count()
    while True:
        often = max(256, total // 1000)
        stars = save(_small_star(_large_star(links, often), often), "stars")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        links, before, total = stars, now, now[0]
    return stars.select(F.col("a").alias("id"), F.col("b").alias("root")).union(stars.select(F.col("b"), F.col("b")).distinct())
