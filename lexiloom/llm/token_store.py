"""Token-id output: documents' ids in one array, with Elias-Fano boundaries.

The file format.  A store is a Parquet table of blocks, in ascending order of
(shard, block); each block holds the ids of consecutive documents:

========== ======== ========================================================
shard      int      range of the sort key, ascending
block      int      place in the shard
first      long     ids before the block in its shard
n_docs     int      documents in the block
n_ids      long     ids in the block
least      long     smallest doc_id of the block, null where it has none
most       long     largest doc_id of the block, null where it has none
doc_ids    binary   int64 little endian, with a bitmap of nulls in front
ends       binary   Elias-Fano code of the documents' end offsets
ids        binary   unsigned 16- or 32-bit little endian, ``width`` bytes each
width      int      bytes of an id
========== ======== ========================================================

Elias-Fano code of m ascending values below u: the low l = floor(log2(u / m))
bits of each value, packed; then a bit vector in which value i sets bit
(value >> l) + i.  ``select`` on that vector recovers the values; every 512th
set bit's position is stored, so that a lookup reads one short run of words
and no table of 64-bit offsets is needed: about 2 + l bits a document.
``fetch`` reads single documents so: of the blocks whose range of doc_ids holds
one that is asked for (Parquet's statistics skip others), two selects and one
slice of the ids a document; ``read_store`` reads everything.

Scale: one range shuffle of the texts; a block is bounded by ``block_ids``, or
one document where that is longer.  Of the store only one number a shard goes
to the driver.

Cases: a null text is the empty one; a null doc_id sorts first; rows with the
same doc_id are kept and sort by their text's hash; an empty table gives an
empty store; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, save, shuffle_parts, slices
from .encoding import encoder

SAMPLE = 512
_BLOCKS = "shard int, block int, first long, n_docs int, n_ids long, least long, most long, doc_ids binary, ends binary, ids binary, width int"


def ef_encode(values: np.ndarray, universe: int) -> bytes:
    """Elias-Fano code of ascending values, each at most ``universe``."""
    m = len(values)
    low_bits = max(0, int(universe // m).bit_length() - 1) if m else 0
    v = values.astype(np.uint64)
    high = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(m)
    upper = np.zeros((int(high[-1]) >> 3) + 1 if m else 0, np.uint8)
    if m:
        np.bitwise_or.at(upper, high >> 3, (1 << (high & 7)).astype(np.uint8))
    if low_bits:
        low = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        lower = np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes()
    else:
        lower = b""
    samples = high[::SAMPLE].astype("<u4").tobytes()
    return struct.pack("<IBII", m, low_bits, len(lower), len(samples)) + lower + samples + upper.tobytes()


class EliasFano:
    """Reads a code: ``select(i)`` one value, ``all()`` every value."""

    def __init__(self, code: bytes):
        self.m, self.low_bits, n_lower, n_samples = struct.unpack_from("<IBII", code)
        at = struct.calcsize("<IBII")
        self.lower = np.frombuffer(code, np.uint8, n_lower, at)
        self.samples = np.frombuffer(code, "<u4", n_samples // 4, at + n_lower)
        self.upper = np.frombuffer(code, np.uint8, len(code) - at - n_lower - n_samples, at + n_lower + n_samples)

    def _low(self, i: int) -> int:
        bits = range(i * self.low_bits, (i + 1) * self.low_bits)
        return sum(((int(self.lower[b >> 3]) >> (b & 7)) & 1) << k for k, b in enumerate(bits))

    def select(self, i: int) -> int:
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = start >> 3
        word = int(self.upper[byte]) & (0xFF << (start & 7))
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.upper[byte])
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        return ((at - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little")).astype(np.int64)
        high = ones[: self.m] - np.arange(self.m)
        if not self.low_bits:
            return high
        low = np.unpackbits(self.lower, count=self.m * self.low_bits, bitorder="little").reshape(self.m, self.low_bits)
        return (high << self.low_bits) | (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def _pack_ids(ids: list) -> bytes:
    null = np.packbits([x is None for x in ids], bitorder="little")
    return null.tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes()


def _unpack_ids(raw: bytes, m: int) -> list:
    head = (m + 7) // 8
    null = np.unpackbits(np.frombuffer(raw, np.uint8, head), count=m, bitorder="little").astype(bool)
    ids = np.frombuffer(raw, "<i8", m, head)
    return ids.tolist() if not null.any() else [None if n else int(x) for x, n in zip(ids, null)]


def write_store(docs: DataFrame, tokenizer: str, kind: str, end_id: int, width: int = 2, block_ids: int = 1 << 20) -> DataFrame:
    """Encodes documents, appends ``end_id`` to each, writes the store and returns it as read."""
    end, dtype = struct.pack("<I", end_id), {2: "<u2", 4: "<u4"}[width]

    def blocks(batches):
        enc, block, first, shard = encoder(tokenizer, kind), 0, 0, 0
        names: list = []
        parts: list[bytes] = []
        n = 0

        def out():
            nonlocal block, first, names, parts, n
            ends = np.cumsum([len(p) // 4 for p in parts])
            ids = np.frombuffer(b"".join(parts), "<u4")
            known = [x for x in names if x is not None]
            if width == 2 and len(ids) and ids.max() > 0xFFFF:
                raise ValueError("an id needs more than 16 bits: use width 4")
            row = {"shard": [shard], "block": [block], "first": [first], "n_docs": [len(names)], "n_ids": [n], "least": [min(known, default=None)], "most": [max(known, default=None)], "doc_ids": [_pack_ids(names)], "ends": [ef_encode(ends, n)], "ids": [ids.astype(dtype).tobytes()], "width": [width]}
            block, first, names, parts, n = block + 1, first + n, [], [], 0
            return row

        for b in slices(batches, 256):
            shard = b.column(2)[0].as_py()
            for d, p in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist())):
                if parts and n + len(p) // 4 + 1 > block_ids:
                    yield out()
                names.append(d)
                parts.append(p + end)
                n += len(p) // 4 + 1
        if parts:
            yield out()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("shard"))
    return save(map_arrow(rows, blocks, _BLOCKS), "token-store")


def _bases(store: DataFrame) -> dict[int, int]:
    """Ids in front of each shard."""
    base, before = {}, 0
    for shard, n in sorted((r[0], r[1]) for r in store.groupBy("shard").agg(F.sum("n_ids")).collect()):  # one row a shard
        base[shard], before = before, before + n
    return base


def fetch(store: DataFrame, doc_ids: list[int], most: int = 10_000) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents with one of at most ``most`` doc_ids, by ``select``."""
    if len(doc_ids) > most:
        raise ValueError(f"more than {most} doc_ids: read the store and join")
    wanted = sorted({int(d) for d in doc_ids})
    bases = store.sparkSession.sparkContext.broadcast(_bases(store))
    if not wanted:
        return read_store(store.limit(0))

    def documents(batches):
        at = np.array(wanted, np.int64)
        for b in slices(batches, 1):
            low, high = (b.column(k)[0].as_py() for k in ("least", "most"))
            here = set(at[np.searchsorted(at, low) : np.searchsorted(at, high, side="right")].tolist())
            if not here:
                continue
            ends, size = EliasFano(b.column("ends")[0].as_py()), b.column("width")[0].as_py()
            ids = np.frombuffer(b.column("ids")[0].as_py(), {2: "<u2", 4: "<u4"}[size])
            before = bases.value[b.column("shard")[0].as_py()] + b.column("first")[0].as_py()
            for i, d in enumerate(_unpack_ids(b.column("doc_ids")[0].as_py(), b.column("n_docs")[0].as_py())):
                if d in here:
                    s, e = ends.select(i - 1) if i else 0, ends.select(i)
                    yield {"doc_id": [d], "start": [before + s], "n_tokens": [e - s], "ids": [ids[s:e].astype("<u4").tobytes()]}

    near = store.where((F.col("most") >= wanted[0]) & (F.col("least") <= wanted[-1]))
    return map_arrow(near, documents, "doc_id long, start long, n_tokens long, ids binary")


def read_store(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, unsigned 32-bit) of each document of a store."""
    bases = store.sparkSession.sparkContext.broadcast(_bases(store))

    def documents(batches):
        for b in slices(batches, 1):
            r = {k: b.column(k)[0].as_py() for k in b.schema.names}
            ends = EliasFano(r["ends"]).all()
            starts = np.concatenate([[0], ends[:-1]])
            ids = np.frombuffer(r["ids"], {2: "<u2", 4: "<u4"}[r["width"]]).astype("<u4")
            at = starts + (bases.value[r["shard"]] + r["first"])
            names = _unpack_ids(r["doc_ids"], r["n_docs"])
            for i in range(0, len(names), 4096):
                j = min(i + 4096, len(names))
                yield {"doc_id": names[i:j], "start": at[i:j], "n_tokens": (ends - starts)[i:j], "ids": [ids[s:e].tobytes() for s, e in zip(starts[i:j], ends[i:j])]}

    return map_arrow(store, documents, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2) -> DataFrame:
    """Round trip: writes the store and derives each document's digest from what is read back."""
    back = read_store(write_store(docs, tokenizer, kind, end_id))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
