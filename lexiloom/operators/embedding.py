"""Embedding seam, its deterministic stand-in, and an index of coarse cells for vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dot, terms, unit


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """Unit vector of a text's words, each counted at one place with one sign by its hash; null without words.

    It stands in for a model where there is none: equal texts have equal vectors.  Words are hashed to
    places by Spark; Python, as a sum over places is not a built-in expression, sees two bytes a word."""

    @F.pandas_udf("array<double>")
    def vector(places):
        import numpy as np
        import pandas as pd

        out = []
        for w in places:
            h = np.asarray(w if w is not None else [], np.int64)
            v = np.bincount(h % dims, np.where(h < dims, 1.0, -1.0), dims)
            n = float(np.sqrt(v @ v))
            out.append((v / n).tolist() if n else None)
        return pd.Series(out)

    return vector(F.transform(terms(text), lambda w: (F.crc32(w.cast("binary")) % (2 * dims)).cast("short" if dims <= 1 << 14 else "int")))


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """id, vector of rows(id, text) by a model called with at most ``batch`` texts, in order.  The model
    is a seam: it is pickled to the tasks and may be a client with its own retries.  No more than
    ``batch`` texts are Python objects at a time."""

    def run(batches: Iterator):
        import pyarrow as pa

        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                vectors = model([t if t is not None else "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(vectors, pa.list_(pa.float64()))], ["id", "vector"])

    return rows.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, vector array<double>")


def cells(vectors: DataFrame, k: int, seed: int = 1, sample: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(id, vector, agency, cell), and centroids (cell, centroid): k-means over unit vectors, fitted on at most
    about ``sample`` rows; every row gets the cell of its nearest centroid.  Write the first partitioned by cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("u", unit(F.col("vector"))).where("u is not null")
    n = max(1, rows.count())
    ready = rows.withColumn("features", array_to_vector("u"))
    model = KMeans(k=k, seed=seed, maxIter=10).fit(ready.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / n)))
    spark = vectors.sparkSession
    centroids = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centroid array<double>")
    placed = model.transform(ready).select("id", "vector", "agency", F.col("prediction").alias("cell"))
    return placed, centroids


def probe(placed: DataFrame, centroids: DataFrame, query: list[float], k: int, cells_read: int) -> DataFrame:
    """id, score: the k nearest by cosine among the cells nearest to the query (partition pruning by cell)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = centroids.select("cell", dot(F.col("centroid"), q).alias("c")).orderBy(F.desc("c"), "cell").limit(cells_read)
    rows = placed.join(F.broadcast(near.select("cell")), "cell")
    return rows.select("id", dot(unit(F.col("vector")), unit(q)).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def isolated(rows: DataFrame, work: Callable[[str], list[str]], key: str = "path") -> DataFrame:
    """key, status, error, parts: work on each content, whose failure fails its row alone; empty output is skipped."""

    def run(frames: Iterator):
        import pandas as pd

        for pdf in frames:
            out = []
            for k, content in zip(pdf[key], pdf.content):
                try:
                    parts = work(content)
                    out.append((k, "success" if parts else "skipped", None, parts))
                except Exception as e:  # noqa: BLE001  any failure of a document is its own
                    out.append((k, "failed", f"{type(e).__name__}: {e}", []))
            yield pd.DataFrame(out, columns=[key, "status", "error", "parts"])

    return rows.select(key, "content").mapInPandas(run, f"{key} string, status string, error string, parts array<string>")


def positional(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks and vectors put together by place (ord), as far as both go."""
    nth = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("batch").orderBy("ord")))
    return nth(chunks).drop("ord").join(nth(vectors).drop("ord"), ["batch", "n"])
