"""Nearest neighbours by pairs of blocks against all pairs."""

import numpy as np
import pytest

from lexiloom.operators import search


def _exact(rows, k):
    out = set()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and any(v)}
    for a, x in unit.items():
        best = sorted((-round(float(x @ y), 12), b) for b, y in unit.items() if b != a)[:k]
        out |= {(a, b, n + 1) for n, (_, b) in enumerate(best)}
    return out


@pytest.mark.parametrize("dims, block", [(3, 1), (8, 7), (8, 100)])
def test_blocks_give_the_exact_nearest(spark, dims, block):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, dims)]) for i in range(30)] + [(30, None), (31, [0.0] * dims)]
    v = spark.createDataFrame([(i, x, "a") for i, x in rows], "id long, vector array<double>, agency string")
    got = search.batch_knn(v, v, 4, block).collect()
    assert {(x["query_id"], x["id"], x["rank"]) for x in got} == _exact(rows, 4)


def test_the_driver_collects_no_vectors(spark, monkeypatch):
    v = spark.createDataFrame([(i, [1.0, float(i)], "a") for i in range(9)], "id long, vector array<double>, agency string")
    collect, most = type(v).collect, []
    monkeypatch.setattr(type(v), "collect", lambda self: most.append(self.columns) or collect(self))
    search.batch_knn(v, v, 2)
    assert not any("vector" in c for c in most)
