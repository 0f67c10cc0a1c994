"""Gradient-boosted trees of fixed depth for the logistic loss, and isotonic calibration.

Trained in numpy on a bounded sample; scored in numpy or as one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    """Perfect binary trees: node k has children 2k + 1 and 2k + 2; x < cut goes left."""

    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2^depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            k = np.zeros(len(x), np.int64)
            while len(k) and k[0] < inner:  # all rows are on one level
                k = 2 * k + 1 + (x[rows, f[k]] >= c[k])
            out += leaf[k - inner]
        return out

    def expression(self, columns: list[Column]) -> Column:
        """The margin as a sum of nested conditions."""
        inner = self.feature.shape[1] if len(self.feature) else 0

        def node(t: int, k: int) -> Column:
            if k >= inner:
                return F.lit(float(self.leaf[t][k - inner]))
            if not np.isfinite(self.cut[t][k]):
                return node(t, 2 * k + 1)
            return F.when(columns[self.feature[t][k]] < F.lit(float(self.cut[t][k])), node(t, 2 * k + 1)).otherwise(node(t, 2 * k + 2))

        out = F.lit(float(self.base))
        for t in range(len(self.feature)):
            out = out + node(t, 0)
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting over quantile bins; ``least``: hessian a leaf needs."""
    n, m = x.shape
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    base, inner = float(np.log(p / (1 - p))), 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    # the largest value below a cut goes left of it, the cut itself right
    code = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
    margin, out = np.full(n, base), []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        place = np.zeros(n, np.int64)
        for k in range(inner):
            rows = np.flatnonzero(place == k)
            best = (1e-6, 0, np.inf, 0)
            if len(rows):
                gr, hr = g[rows], h[rows]
                gs, hs = gr.sum(), hr.sum()
                for j in range(m):
                    size = len(cuts[j]) + 1
                    if size < 2:
                        continue
                    gl = np.cumsum(np.bincount(code[rows, j], gr, size))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, j], hr, size))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(hl < least) | (hs - hl < least)] = -1
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, float(cuts[j][i]), i)
            feature[k], cut[k] = best[1], best[2]
            right = code[rows, best[1]] > best[3] if np.isfinite(best[2]) else np.zeros(len(rows), bool)
            place[rows] = 2 * k + 1 + right
        for k in range(inner + 1):
            rows = place == k + inner
            leaf[k] = -rate * g[rows].sum() / (h[rows].sum() + ridge)
        margin += leaf[place - inner]
        out.append((feature, cut, leaf))
    return Trees(base, *(np.array(z) for z in zip(*out)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators: knots for ``np.interp``.

    Blocks are shrunk to the overall rate by one pseudo-row, so that no score is exactly 0 or 1."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    rate = float(y.mean())
    at = np.array([b[2] / b[1] for b in blocks])
    return at, np.maximum.accumulate(np.array([(b[0] + rate) / (b[1] + 1) for b in blocks]))
