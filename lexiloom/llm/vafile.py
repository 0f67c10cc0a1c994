"""Exact top-k by inner product with a vector-approximation file.

Each component is an integer floor(scale * x).  The file has two tables: the
approximations (one byte a component: its cell on a grid between the
component's least and largest value) and the exact vectors.  With v in cell c,
q . v lies between q . low(c) + a and q . low(c) + b, where a and b depend on
the query alone (cells of a component are equally wide), so that the bounds of
all candidates follow from one product, and their order is that of the bounds.

1. Scan: query blocks meet candidate blocks of approximations; of each block a
   query keeps the candidates whose upper bound reaches the k-th best lower one.
2. Of all that is kept, a query's k best by bound are read exactly; their k-th score is a limit.
3. What remains with an upper bound that reaches the limit is read exactly, so
   the k-th result is certain.

Exact vectors are read by a join with what steps 2 and 3 ask for only.

Scale: nothing but counts and two numbers a component goes to the driver.
Query blocks have at most ``query_block`` queries, a task streams the candidates past one of
them, and sends k rows a query and those between its bounds.  Only
approximations are copied: once for each query block, while the queries are copied once for each candidate
block; the number of candidate blocks is what fills the shuffle partitions.

Cases: vectors that are null or hold a null or non-finite component take no
part, nor do rows without vec_id; vectors of unequal length are compared as if
padded with zeros; rows with the query's own vec_id are not its candidates;
repeated rows are candidates (and queries) each; ties go to the smaller
vec_id; fewer than k candidates give all; an empty table gives no rows; other
columns are ignored.  Scores beyond 64 bits are held at the limits of long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, save, shuffle_parts, slices

CELLS = 256


def _integers(col, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector of an Arrow list column, None where it takes no part."""
    out: list[np.ndarray | None] = []
    for v in col:
        v = v.values if v.is_valid else None
        if v is None or v.null_count:
            out.append(None)
            continue
        x = np.floor(scale * v.to_numpy(zero_copy_only=False).astype(np.float64)) if len(v) else np.zeros(0)
        out.append(np.clip(x, -(2.0**62), 2.0**62).astype(np.int64) if np.isfinite(x).all() else None)
    return out


def _matrix(raw: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(raw), dims), np.int64)
    for r, v in zip(out, raw):
        v = np.frombuffer(v, "<i8")
        r[: len(v)] = v
    return out


class Grid:
    """Least value and width of the cells by component."""

    def __init__(self, low: list[int], high: list[int]):
        self.low = np.array(low, np.int64)
        self.width = np.array([max(1, -(-(b - a + 1) // CELLS)) for a, b in zip(low, high)], np.int64)

    def cells(self, v: np.ndarray) -> np.ndarray:
        return ((v - self.low) // self.width).astype(np.uint8)

    def reach(self, q: np.ndarray) -> float:
        """No bound of a query of ``q`` is larger."""
        most = np.maximum(np.abs(self.low.astype(float)), np.abs(self.low.astype(float) + self.width.astype(float) * CELLS))
        return float(most @ np.abs(q.astype(float)).max(axis=0)) if q.size else 0.0


def build(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame, Grid]:
    """Exact vectors (row, vec_id, exact), approximations (row, vec_id, cells), both in the shared folder, and the grid."""

    def exact(batches):
        for b in slices(batches, 4096):
            got = [(i, v) for i, v in zip(b.column(0).to_pylist(), _integers(b.column(1), scale)) if i is not None and v is not None]
            yield {"vec_id": [i for i, _ in got], "exact": [v.astype("<i8").tobytes() for _, v in got]}

    ints = map_arrow(vectors.select(F.col(id_col).cast("long"), F.col(vector_col)), exact, "vec_id long, exact binary")
    ints = save(ints.select(F.monotonically_increasing_id().alias("row"), "vec_id", "exact"), "vectors")

    def ranges(batches):
        lo = hi = np.zeros(0, np.int64)
        for b in slices(batches, 4096):
            for v in b.column(0).to_pylist():
                v = np.frombuffer(v, "<i8")
                if len(v) > len(lo):
                    lo, hi = (np.pad(z, (0, len(v) - len(z))) for z in (lo, hi))
                lo[: len(v)] = np.minimum(lo[: len(v)], v)
                hi[: len(v)] = np.maximum(hi[: len(v)], v)
        yield {"d": np.arange(len(lo), dtype=np.int32), "lo": lo, "hi": hi}

    # a shorter vector has zeros at its end, which the grid must hold too
    found = map_arrow(ints.select("exact"), ranges, "d int, lo long, hi long").groupBy("d").agg(F.least(F.min("lo"), F.lit(0)), F.greatest(F.max("hi"), F.lit(0))).orderBy("d").collect()  # one row a component
    grid = Grid([r[1] for r in found], [r[2] for r in found])

    def cells(batches):
        for b in slices(batches, 4096):
            yield {"row": b.column(0), "vec_id": b.column(1), "cells": [c.tobytes() for c in grid.cells(_matrix(b.column(2).to_pylist(), len(grid.low)))]}

    return ints, save(map_arrow(ints, cells, "row long, vec_id long, cells binary"), "va-file"), grid


def _scan(dealt: DataFrame, grid: Grid, k: int) -> DataFrame:
    """From rows (pair, side, row, vec_id, vector) sorted by pair and side (0: exact queries, 1: cells of candidates):
    number, query_id, row, vec_id, bound (the product with the cell's least corner), slack (upper less lower bound)."""

    def run(batches):
        pair, asked, q = None, [], None
        state: dict = {}

        def start():
            nonlocal q
            q = _matrix([x[2] for x in asked], len(grid.low))
            reach = grid.reach(q)
            kind = np.float32 if reach < 2**23 else np.float64
            slack = np.abs(q.astype(float)) @ (grid.width - 1).astype(float) + (reach * 1e-9 if reach >= 2**52 else 0.0)
            state.update(ids=np.array([x[1] for x in asked], np.int64), q=q.astype(kind), slack=slack, least=np.full(len(q), -np.inf), kept=[])

        def close():
            """Each query's candidates whose upper bound reaches its k-th best lower bound."""
            if not asked or not state.get("kept"):
                return
            at, b, row, vec = (np.concatenate([x[c] for x in state["kept"]]) for c in range(4))
            order = np.lexsort((-b, at))
            at, b, row, vec = at[order], b[order], row[order], vec[order]
            first = np.searchsorted(at, np.arange(len(asked)))
            n = np.append(first[1:], len(at)) - first
            least = np.where(n >= k, b[np.minimum(first + k - 1, len(b) - 1)] - state["slack"], -np.inf)
            keep = b >= least[at]
            at, b, row, vec = at[keep], b[keep], row[keep], vec[keep]
            number, query = np.array([x[0] for x in asked], np.int64), state["ids"]
            for s in range(0, len(at), 1 << 16):
                a = at[s : s + (1 << 16)]
                yield {"number": number[a], "query_id": query[a], "row": row[s : s + len(a)], "vec_id": vec[s : s + len(a)], "bound": b[s : s + len(a)].astype(float), "slack": state["slack"][a]}

        def take(names, rows, cells):
            corner = (grid.low + np.frombuffer(b"".join(cells), np.uint8).reshape(len(names), len(grid.low)).astype(np.int64) * grid.width).astype(state["q"].dtype)
            for s in range(0, len(asked), 1024):
                ids, least = state["ids"][s : s + 1024], state["least"][s : s + 1024]
                b = state["q"][s : s + 1024] @ corner.T
                b[ids[:, None] == names[None, :]] = -np.inf
                if len(names) > k:
                    best = np.partition(b, -k, axis=1)[:, -k] - state["slack"][s : s + 1024]
                    np.maximum(least, best, out=least)
                i, j = np.nonzero((b >= least[:, None]) & (b > -np.inf))
                state["kept"].append((i + s, b[i, j], rows[j], names[j]))
            if sum(len(x[0]) for x in state["kept"]) > 64 * k * len(asked) + (1 << 20):
                at, b, row, vec = (np.concatenate([x[c] for x in state["kept"]]) for c in range(4))
                keep = b >= state["least"][at]
                state["kept"] = [(at[keep], b[keep], row[keep], vec[keep])]

        for batch in slices(batches, 2048):
            p, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (side[1:] != side[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]):
                if pair != p[s]:
                    yield from close()
                    pair, asked, q = int(p[s]), [], None
                    state.clear()
                part = batch.slice(s, e - s)
                if side[s] == 0:
                    asked += zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist())
                elif asked:
                    if q is None:
                        start()
                    take(part.column(3).to_numpy(), part.column(2).to_numpy(), part.column(4).to_pylist())
        yield from close()

    return map_arrow(dealt, run, "number long, query_id long, row long, vec_id long, bound double, slack double")


def _scores(asked: DataFrame, exact: DataFrame, dims: int) -> DataFrame:
    """number, query_id, vec_id, score: exact inner products of rows (number, query_id, row, vec_id)."""

    def run(batches):
        limit = 2**63 - 1
        for b in slices(batches, 4096):
            q, v = (_matrix(b.column(c).to_pylist(), dims) for c in (3, 4))
            if (np.abs(q.astype(float)) * np.abs(v.astype(float))).sum(axis=1).max(initial=0.0) < 2**62:
                score = (q * v).sum(axis=1)
            else:
                score = np.array([max(-limit - 1, min(limit, int(np.dot(x.astype(object), y.astype(object))))) for x, y in zip(q, v)], np.int64)
            yield {"number": b.column(0), "query_id": b.column(1), "vec_id": b.column(2), "score": score}

    have = asked.join(exact.select("row", F.col("exact").alias("__v")), "row")
    have = have.join(exact.select(F.col("row").alias("number"), F.col("exact").alias("__q")), "number")
    return map_arrow(have.select("number", "query_id", "vec_id", "__q", "__v"), run, "number long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 20, query_block: int = 16384, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row where ``is_query`` holds."""
    exact, cells, grid = build(vectors, scale)
    parts = shuffle_parts(vectors.sparkSession)
    queries = exact.where(is_query)
    n, m = cells.count(), queries.count()
    q_blocks = max(1, -(-m // query_block))
    c_blocks = max(1, min(-(-parts // q_blocks), -(-n // 16384)))
    spread = lambda i, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(i)
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    pair = (F.col("q").cast("long") * c_blocks + F.col("c")).alias("pair")
    left = queries.select(block(q_blocks).alias("q"), spread("c", c_blocks), "row", "vec_id", "exact").select(pair, F.lit(0).alias("side"), "row", "vec_id", F.col("exact").alias("vector"))
    right = cells.select(block(c_blocks).alias("c"), spread("q", q_blocks), "row", "vec_id", "cells").select(pair, F.lit(1).alias("side"), "row", "vec_id", F.col("cells").alias("vector"))
    dealt = left.union(right).repartition(max(1, min(parts, q_blocks * c_blocks)), "pair").sortWithinPartitions("pair", "side")
    found = save(_scan(dealt, grid, k), "bounds")
    order = Window.partitionBy("number").orderBy(F.desc("bound"), "row")
    first = save(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k), "first")
    read = save(_scores(first.drop("nth", "bound", "slack"), exact, len(grid.low)), "scores")
    # the k-th score so far; without k candidates there is no limit, and no more to read
    limit = read.groupBy("number").agg(F.count("*").alias("n"), F.min("score").alias("limit")).where(F.col("n") == k)
    more = found.join(first.select("number", "row"), ["number", "row"], "left_anti").join(limit, "number").where(F.col("bound") + F.col("slack") + F.abs("bound") * 1e-9 + 1 >= F.col("limit"))
    # every upper bound is the lower corner's product and what positive and negative components can add: at most slack
    scores = read.union(_scores(more.select("number", "query_id", "row", "vec_id"), exact, len(grid.low)))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
