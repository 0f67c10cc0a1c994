"""Vector search, batch nearest neighbours and BM25."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K, BM25_K1, VECTOR_K
from ..functions import cosine, terms


def agency_filter(df: DataFrame, agencies: list[str] | None, valid: list[str] | None = None) -> DataFrame:
    """Rows of the named agencies; names that are not valid are dropped, and none left means no filter."""
    names = [a for a in agencies or [] if valid is None or a in valid]
    return df.where(F.col("agency").isin(names)) if names else df


def vector_topk(vectors: DataFrame, query: list[float] | Column, k: int = VECTOR_K, agencies: list[str] | None = None, valid: list[str] | None = None) -> DataFrame:
    """id, score of the k nearest by cosine; the filter lies below the score and only
    id, vector and agency are read.  Ends in a top-k per task and a merge of k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    near = agency_filter(vectors, agencies, valid).select("id", cosine(F.col("vector"), q).alias("score"))
    return near.where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def batch_knn(queries: DataFrame, base: DataFrame, k: int, block: int = 32_768) -> DataFrame:
    """query_id, id, score: for each row of ``queries(id, vector, agency)`` its k nearest rows
    of ``base`` by cosine, other than itself (ties by id).

    Both sides go by blocks of about ``block`` rows (fewer of long vectors, and to have work for 64 tasks), and every block of queries meets every block of base
    in a task of its own, as matrices: the pairs are all compared, as the result needs, but no task or driver
    holds more than two blocks, and a task returns k rows a query."""
    (n, _), (m, dims) = (x.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first() for x in (queries, base))
    block = max(1, min(block, max(1024, (1 << 22) // max(1, dims))))
    here, there = (max(1, -(-x // block), min(8, -(-x // 4096))) for x in (n, m))
    side = lambda rows, blocks, name: rows.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").alias("vector"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(name))
    q = side(queries, here, "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(there - 1)))).select("i", "j", "id", "vector")
    v = side(base, there, "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(here - 1)))).select("i", "j", "id", "vector")
    # a task for every few pairs of blocks, whatever the size of their shuffle
    tasks = min(here * there, max(16, here * there // 4))
    q, v = (x.repartition(tasks, "i", "j") for x in (q, v))
    found = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(lambda a, b: _nearest(a, b, k), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit_rows(table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have a direction, by id."""
    ids = table.column("id").to_numpy()
    column = table.column("vector").combine_chunks()
    v = np.asarray(column.flatten(), np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    length = np.linalg.norm(v, axis=1)
    order = np.argsort(ids, kind="stable")
    order = order[length[order] > 0]
    return ids[order], v[order] / length[order, None]


def _nearest(queries, base, k: int, rows: int = 256):
    """The k nearest of ``base`` to each of ``queries``, both Arrow tables (id, vector), ties of 12 places by id.

    Single precision finds those that can be among them, by a margin over its error on unit vectors; doubles order these."""
    import pyarrow as pa

    (names, q), (own, v) = _unit_rows(queries), _unit_rows(base)
    out: list[tuple] = []
    margin = np.float32(1e-5 + v.shape[1] * 2.0**-22)
    q32, v32 = q.astype(np.float32), v.astype(np.float32)
    for at in range(0, len(names) if len(own) else 0, rows):
        s = q32[at : at + rows] @ v32.T
        same = np.searchsorted(own, names[at : at + rows])
        for copy in range(int(np.unique(own, return_counts=True)[1].max())):  # a row itself, however often it is there
            where = np.minimum(same + copy, len(own) - 1)
            hit = own[where] == names[at : at + rows]
            s[np.flatnonzero(hit), where[hit]] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if len(own) > k else np.full(len(s), -np.inf, np.float32)
        i, j = np.nonzero(s >= np.maximum(least - margin, np.float32(-2))[:, None])
        exact = np.einsum("nd,nd->n", q[at + i], v[j])
        order = np.lexsort((j, -np.round(exact, 12), i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        out.append((names[at + i[keep]], own[j[keep]], exact[keep]))
    columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.table(dict(zip(("query_id", "id", "score"), columns)))


@dataclass
class TextIndex:
    """Postings (id, term, tf, agency), one row a document and term, and document lengths."""

    postings: DataFrame
    lengths: DataFrame


def index_text(chunks: DataFrame) -> TextIndex:
    """Inverted index of ``chunks(id, text, agency)``; persist its tables to search more than once."""
    words = chunks.select("id", "agency", terms(F.col("text")).alias("words"))
    lengths = words.select("id", "agency", F.size("words").alias("length"))
    postings = words.select("id", "agency", F.explode("words").alias("term")).groupBy("id", "agency", "term").agg(F.count("*").alias("tf"))
    return TextIndex(postings, lengths)


def _frequency(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25_topk(chunks: DataFrame, query: str, k: int = BM25_K, agencies: list[str] | None = None, valid: list[str] | None = None) -> DataFrame:
    """id, score of the k best by BM25 over the (filtered) chunks; an empty query gives no rows.

    Without a stored index the query's terms are counted in place: one pass, and
    statistics of one row a term are the only exchange."""
    import re

    wanted = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    rows = agency_filter(chunks, agencies, valid).select("id", terms(F.col("text")).alias("words"))
    if not wanted:
        return rows.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    # the words of a text are found once, and what the query needs of them is counted there
    counts = F.transform(F.array("words"), lambda ws: F.struct(F.size(ws).alias("length"), *[_frequency(ws, t).alias(f"tf{i}") for i, t in enumerate(wanted)]))
    rows = rows.select("id", F.get(counts, F.lit(0)).alias("c")).select("id", "c.*")
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    scored = rows.crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean")))
    return scored.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def bm25_index_topk(index: TextIndex, query: str, k: int = BM25_K) -> DataFrame:
    """The same from a stored index: reads only the postings of the query's terms."""
    import re

    wanted = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    hits = index.postings.where(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = index.lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    rows = hits.join(F.broadcast(df), "term").join(index.lengths.select("id", "length"), "id").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean")))
    return rows.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)
