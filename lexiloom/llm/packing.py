"""Packing documents into sequences of a fixed window by non-negative least squares.

Each document's ids (with the end id) are cut into full windows, each its own
sequence, and a rest shorter than the window.  The rests of a packing group
(consecutive rows of one partition, at most ``group_docs``) are packed so:

1. histogram of rest lengths;
2. shallow combinations of at most three lengths that fill the window exactly;
3. non-negative least squares for how often each combination is repeated, so
   that the combinations use up the histogram;
4. counts rounded up, then held to what is left of each length, in order of size;
   1 to 4 are repeated on what remains until no combination fits it or a round places little;
5. what remains is packed greedily, longest first, each gap filled by the
   longest rest that fits or, failing that, by cutting the next one.

Only the rests of step 5 are ever cut.  The last, unfilled sequence of a group
is cut into powers of two, which need no padding.

Scale: groups are packed where they lie - no shuffle, nothing on the driver,
memory bounded by a group's rests (group_docs * window ids); padding is zero
whatever the group size, and a sequence never spans groups.  A group's content
depends only on its input partition, so a task that is run again on another
executor gives the same sequences.

Cases: a null text is the empty one (the end id alone); repeated rows are
packed each; an empty table gives no rows; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices
from .encoding import encoder

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, most: int = 1024) -> list[tuple[int, ...]]:
    """Pairs and triples of occurring lengths whose sum is the window, in order
    of how often they could be used; at most ``most`` (a bound on the size of one round of
    the solver, not on what is packed: later rounds see what is left)."""
    have = {int(a): int(c) for a, c in zip(lengths, counts)}
    found = []
    for a in have:
        b = window - a
        if a <= b and b in have:
            found.append((min(have[a], have[b]) if a != b else have[a] // 2, (a, b)))
    for i, a in enumerate(lengths):
        rest = window - int(a)
        bs = lengths[i:]
        cs = rest - bs
        for b, c in zip(bs[cs >= bs], cs[cs >= bs]):
            if int(c) in have:
                trio = (int(a), int(b), int(c))
                n = min(have[x] // trio.count(x) for x in trio)
                found.append((n, trio))
    found = [x for x in found if x[0] > 0]
    found.sort(key=lambda x: (-x[0], len(x[1]), x[1]))
    return [c for _, c in found[:most]]


class Uses:
    """The matrix of how often each combination (column) uses each length (row); a column has at most three entries."""

    def __init__(self, combos: list[tuple[int, ...]], row: dict[int, int]):
        self.rows = len(row)
        self.at = np.array([[row[x] for x in c] + [self.rows] * (3 - len(c)) for c in combos], np.int64).reshape(-1, 3)
        self.shape = (self.rows, len(combos))

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at.ravel(), np.repeat(x, 3), self.rows + 1)[: self.rows]

    @property
    def T(self) -> "_Transposed":
        return _Transposed(self)


class _Transposed:
    def __init__(self, uses: Uses):
        self.uses = uses

    def __matmul__(self, y: np.ndarray) -> np.ndarray:
        return np.append(y, 0.0)[self.uses.at].sum(axis=1)


def nnls(a: np.ndarray | Uses, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """argmin ||a x - b|| over x >= 0, by accelerated projected gradient steps."""
    n = a.shape[1]
    if not n:
        return np.zeros(0)
    t_a, h = a.T, a.T @ b
    v = np.ones(n)
    for _ in range(30):
        v = t_a @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1.0 / (float(v @ (t_a @ (a @ v))) * 1.05)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (t_a @ (a @ y) - h))
        if (new - x) @ (y - new) > 0:
            t = 1.0
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def solve(values: np.ndarray, counts: np.ndarray, window: int, rounds: int = 16) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used, by rounds of least squares on the histogram that is left."""
    left, out = {int(v): int(n) for v, n in zip(values, counts)}, []
    for _ in range(rounds):
        have = np.array([v for v, n in left.items() if n], np.int64)
        number = np.array([left[int(v)] for v in have], np.int64)
        combos = combinations(have, number, window)
        if not combos:
            break
        a = Uses(combos, {int(v): k for k, v in enumerate(have)})
        used, before = 0, sum(left.values())
        for c, n in sorted(zip(combos, np.ceil(nnls(a, number.astype(float)) - 0.01)), key=lambda z: -z[1]):
            n = min(int(n), *(left[x] // c.count(x) for x in c))
            if n > 0:
                out.append((c, n))
                for x in c:
                    left[x] -= n
                used += n * len(c)
        if used < before // 50:
            break
    return out


def plan(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (index of the rest, first id, ids) that hold every rest."""
    size = np.asarray(lengths, np.int64)
    bins: dict[int, list[int]] = {}
    for i in np.argsort(size, kind="stable"):
        bins.setdefault(int(size[i]), []).append(int(i))
    for ids in bins.values():
        ids.reverse()
    values = np.array(sorted(bins), np.int64)
    counts = np.array([len(bins[int(v)]) for v in values], np.int64)
    out: list[list[tuple[int, int, int]]] = []
    for c, n in solve(values, counts, window):
        out += [[(bins[x].pop(), 0, x) for x in c] for _ in range(n)]
    # greedy: (length, index, first id), longest first
    import bisect

    left = sorted((v, i, 0) for v, ids in bins.items() for i in ids)
    while left:
        seq, room = [], window
        while left and room:
            k = bisect.bisect_right(left, (room, 1 << 62, 0)) - 1
            if k >= 0:
                v, i, at = left.pop(k)
                take = v
            else:  # each is longer than the gap: the shortest is cut
                v, i, at = left.pop(0)
                take = room
                bisect.insort(left, (v - take, i, at + take))
            seq.append((i, at, take))
            room -= take
        out.append(seq)
        if room:  # nothing is left: the last sequence, in powers of two
            out.pop()
            out += _powers(seq)
    return out


def _powers(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    total, out, k = sum(s[2] for s in seq), [], 0
    seq = list(seq)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            i, at, n = seq[k]
            take = min(n, room)
            part.append((i, at, take))
            room -= take
            if take == n:
                k += 1
            else:
                seq[k] = (i, at + take, n - take)
        out.append(part)
    return out


def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, window: int = 1024, group_docs: int = 16384) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches):
        from pyspark import TaskContext

        enc, number = encoder(tokenizer, kind), TaskContext.get().partitionId() << 40
        rests: list[tuple] = []

        def flush():
            nonlocal number
            seqs = plan([len(r[1]) // 4 for r in rests], window)
            for i in range(0, len(seqs), 4096):
                out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
                for seq in seqs[i : i + 4096]:
                    offset = 0
                    for r, at, n in seq:
                        d, ids, start, total = rests[r]
                        _add(out, d, start + at, ids[4 * at : 4 * (at + n)], total, number, offset)
                        offset += n
                    number += 1
                yield out
            rests.clear()

        for b in slices(batches, 256):
            out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for d, ids in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                full = n - n % window
                for at in range(0, full, window):
                    _add(out, d, at, ids[4 * at : 4 * (at + window)], n, number, 0)
                    number += 1
                if full < n:
                    rests.append((d, ids[4 * full :], full, n))
            if out["doc_id"]:
                yield out
            if len(rests) >= group_docs:
                yield from flush()
        if rests:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_arrow(rows, pieces, _PIECES)


def _add(out: dict, d, start: int, ids: bytes, total: int, number: int, offset: int) -> None:
    for k, v in zip(out, (d, start, len(ids) // 4, ids, total, number, offset)):
        out[k].append(v)


def pack_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces with a checksum instead of their ids."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
