"""Mixing sources to target weights with a low-discrepancy schedule.

Size of a document: its words.  Sources in order of code point, null last,
have weights 5, 2, 1, repeating; targets share 100% of all words by weight,
and one that exceeds ``most_epochs`` times its source's words stops there and
its excess is shared again by weight.

Each source's documents are shuffled (ordered by a hash of doc_id) into a
stream of words, cut into blocks of equal size near the mean document.  Slot i
of the schedule takes the golden-ratio point frac(i * phi) and goes, through
the cumulative weights of the sources (weights in blocks), to one source;
slots are ranked per source, and the slot of rank r takes block r modulo the
source's blocks, so a source is repeated only when its stream is used up.
Ranks beyond a source's target are skipped and the few ranks that the points
leave short are put where an even spread has them, so each source takes its
target to the word; the last slot takes a part of its block.  ``mixed`` gives
the documents with the slot of the block that each copy begins in, and
``mixed_documents`` lays them out by slot, so that any stretch of the output
has its sources in proportion.

Scale: the texts are read once and give a narrow table of sizes.  Streams are
laid out in two steps: words by (source, hash range), with as many ranges as
four times the shuffle partitions, then running sums within each range, so a
source with a third of all rows is spread over all tasks.  The schedule is
generated in chunks, ranked the same way, written once, and summed by block before it meets
the documents.  Laid out by slot, ranges of slots are dealt to tasks by hash and sorted there.  The driver gets one row a source (an error beyond
``max_sources``).

Cases: a null or empty text has no words, takes nothing and is returned;
repeated rows are entries of their own; a null source is the last; a null
doc_id hashes as the empty text; an empty table gives no rows; other columns
are ignored by ``mix`` and kept by ``mixed`` and ``mixed_documents``; documents
without words have slot 0.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, save, shuffle_parts, word_count

WEIGHTS, MOST_EPOCHS, CHUNK = (5, 2, 1), 3, 1 << 14
_PHI = 2654435769  # 2^32 over the golden ratio


def targets(sizes: list[int], weights: list[int], most: int = MOST_EPOCHS) -> list[float]:
    """Words each source should give: by weight, at most ``most`` times its size."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weights[i] / weight > most * sizes[i]]
        for i in over:
            out[i] = float(most * sizes[i])
        if not over:
            for i in sorted(open_):
                out[i] = left * weights[i] / weight
            break
        open_ -= set(over)
    return out


def points(i: np.ndarray) -> np.ndarray:
    """Golden-ratio points of slots, as integers below 2^32."""
    return (i.astype(np.uint64) * np.uint64(_PHI)) & np.uint64(0xFFFFFFFF)


class Plan:
    """Per source: name, words, target, words to take, blocks, slots; and the schedule's length."""

    def __init__(self, rows: list[tuple[str | None, int, int]]):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
        self.names = [r[0] for r in rows]
        self.sizes = [r[1] for r in rows]
        self.targets = targets(self.sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
        self.take = [int(math.floor(t + 0.5)) for t in self.targets]
        total, docs = sum(self.sizes), sum(r[2] for r in rows)
        block = max(1, total // max(1, docs))
        self.blocks = [max(1, -(-s // block)) for s in self.sizes]
        # slot k of a source ends at word (k + 1) * size / blocks of its repeated stream
        self.slots = [-(-t * b // s) if s else 0 for t, b, s in zip(self.take, self.blocks, self.sizes)]
        self.length = sum(self.slots)
        self.edges = np.array([(c << 32) // max(1, self.length) for c in np.cumsum(self.slots).tolist()], np.uint64)

    def sources(self, i: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, points(i), side="right")


def _sizes(docs: DataFrame) -> DataFrame:
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), h.alias("h"))


def plan(sizes: DataFrame, max_sources: int = 100_000) -> Plan:
    rows = [tuple(r) for r in sizes.groupBy("source").agg(F.sum("size"), F.count("*")).limit(max_sources + 1).collect()]
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    return Plan(rows)


def streams(sizes: DataFrame, p: Plan) -> DataFrame:
    """Every document's place in its source's shuffled stream of words: s (source's number), start, uid."""
    spark = sizes.sparkSession
    names = spark.createDataFrame([(n, k) for k, n in enumerate(p.names)] or [(None, 0)], "name string, s int")
    ranges = 4 * shuffle_parts(spark)
    rows = sizes.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("int"))
    sums = rows.groupBy("s", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("s", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("s", "range").orderBy("h", "doc_id", "size")
    placed = rows.withColumn("nth", F.row_number().over(within)).withColumn("run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(bases, ["s", "range"])
    return placed.select("doc_id", "source", "size", "s", (F.col("base") + F.col("run") - F.col("size")).alias("start"), F.struct("s", "range", "nth").alias("uid"))


def schedule(spark, p: Plan) -> DataFrame:
    """The slots: slot, s, rank, block, lo, hi (words of the source's stream that the slot takes)."""
    shared = spark.sparkContext.broadcast(p)
    chunks = spark.range(0, -(-p.length // CHUNK), 1, shuffle_parts(spark))

    def counts(batches):
        q = shared.value
        for b in batches:
            for c in b.column(0).to_pylist():
                s, n = np.unique(q.sources(np.arange(c * CHUNK, min((c + 1) * CHUNK, q.length))), return_counts=True)
                yield {"chunk": [c] * len(s), "s": s.astype(np.int32), "n": n}

    counted = map_arrow(chunks, counts, "chunk long, s int, n long")
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("chunk", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.groupBy("chunk").agg(F.collect_list(F.struct("s", "base")).alias("bases"))

    def slots(batches):
        q = shared.value
        for b in batches:
            for c, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i = np.arange(c * CHUNK, min((c + 1) * CHUNK, q.length))
                s = q.sources(i)
                order = np.argsort(s, kind="stable")
                rank = np.empty(len(i), np.int64)
                first = np.searchsorted(s[order], s[order])
                rank[order] = np.arange(len(i)) - first
                add = np.zeros(len(q.names), np.int64)
                for x in base:
                    add[x["s"]] = x["base"]
                yield {"slot": i, "s": s.astype(np.int32), "rank": rank + add[s]}

    ranked = map_arrow(bases, slots, "slot long, s int, rank long")
    have = counted.groupBy("s").agg(F.sum("n").alias("n"))
    info = spark.createDataFrame([(k, p.sizes[k], p.blocks[k], p.take[k], p.slots[k]) for k in range(len(p.names))] or [(0, 0, 1, 0, 0)], "s int, size_s long, blocks long, take_s long, need long")
    short = info.join(have, "s", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < need")
    added = short.select("s", "need", F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("rank"))
    added = added.select(F.expr(f"CAST((2 * rank + 1) * {p.length}D / (2 * need) AS BIGINT)").alias("slot"), "s", "rank")
    out = ranked.union(added).join(F.broadcast(info), "s").where("rank < need")
    k = F.col("rank") % F.col("blocks")
    lo, hi = F.expr("(rank % blocks) * size_s div blocks"), F.expr("(rank % blocks + 1) * size_s div blocks")
    left = F.expr("take_s - (rank div blocks) * size_s")
    return out.select("slot", "s", "rank", k.alias("block"), lo.alias("lo"), F.least(hi, left).alias("hi"))


def taken(docs: DataFrame) -> tuple[DataFrame, Plan, DataFrame]:
    """uid, doc_id, source, size, s, start, taken of every row, through schedule and blocks; and plan and schedule."""
    spark = docs.sparkSession
    sizes = save(_sizes(docs), "sizes")
    p = plan(sizes)
    placed = save(streams(sizes, p), "streams")
    info = spark.createDataFrame([(k, p.sizes[k], p.blocks[k]) for k in range(len(p.names))] or [(0, 0, 1)], "s int, size_s long, blocks long")
    # the blocks that a document's words lie in: block k starts at floor(k * size / blocks)
    at = placed.where("size > 0").join(F.broadcast(info), "s")
    first, last = F.expr("((start + 1) * blocks - 1) div size_s"), F.expr("((start + size) * blocks - 1) div size_s")
    parts = at.select("uid", "s", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    slots = save(schedule(spark, p), "schedule")
    uses = slots.groupBy("s", "block", "lo", "hi").agg(F.count("*").alias("uses"))
    words = F.greatest(F.lit(0), F.least(F.col("hi"), F.col("start") + F.col("size")) - F.greatest("lo", "start")) * F.col("uses")
    got = parts.join(uses, ["s", "block"]).groupBy("uid").agg(F.sum(words).alias("taken"))
    return placed.join(got, "uid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")), p, slots


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows, p, _ = taken(docs)
    info = docs.sparkSession.createDataFrame([(k, p.sizes[k], p.targets[k]) for k in range(len(p.names))] or [(0, 0, 0.0)], "s int, source_size long, target double")
    return rows.join(F.broadcast(info), "s").select("doc_id", "size", "source_size", "target", "taken")


def _copies(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, source, size and the slots of the copies (a part of a document rounded to the nearest whole) of
    every row that is taken; and the schedule's length."""
    rows, p, slots = taken(docs)
    n = F.when(F.col("size") == 0, 1).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).cast("int")
    info = docs.sparkSession.createDataFrame([(k, p.sizes[k], p.blocks[k]) for k in range(len(p.names))] or [(0, 0, 1)], "s int, size_s long, blocks long")
    rows = rows.withColumn("n", n).where("n > 0").join(F.broadcast(info), "s")
    # copy e of a document begins in the block of its first word, at rank e * blocks + block
    block = F.expr("if(size_s = 0, 0, ((start + 1) * blocks - 1) div size_s)")
    each = rows.select("uid", "doc_id", "source", "size", "s", block.alias("block"), "blocks", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("e"))
    each = each.withColumn("rank", F.col("e") * F.col("blocks") + F.col("block"))
    each = each.join(slots.select("s", "rank", "slot"), ["s", "rank"], "left")
    return each.groupBy("uid", "doc_id", "source", "size").agg(F.sort_array(F.collect_list(F.coalesce("slot", F.lit(0)))).alias("slots")), p.length


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with ``slot``.  Documents without words stay, once."""
    return _mixed(docs)[0].select(*docs.columns, F.col("__slot").alias("slot"))


def _mixed(docs: DataFrame) -> tuple[DataFrame, int]:
    copies, length = _copies(docs)
    key = ["doc_id", "source", "size"]
    # rows of one key: more copies go to the smaller texts
    counts = copies.groupBy(*(F.col(c).alias(f"__{c}") for c in key)).agg(F.sort_array(F.collect_list(F.struct((-F.size("slots")).alias("n"), "slots"))).alias("__n"))
    order = Window.partitionBy("doc_id", "__src", "__words").orderBy("text")
    out = docs.withColumn("__src", F.col("source").cast("string")).withColumn("__words", word_count(F.col("text").cast("string"))).withColumn("__nth", F.row_number().over(order))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & F.col("__src").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    out = out.join(counts, on).where(F.col("__nth") <= F.size("__n"))
    return out.withColumn("__slot", F.explode(F.element_at("__n", F.col("__nth"))["slots"])), length


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix as rows like ``docs``, laid out by slot: every task has ranges of the schedule, in order."""
    rows, length = _mixed(docs)
    ranges = 4 * shuffle_parts(docs.sparkSession)
    rows = rows.withColumn("__range", F.expr(f"CAST(__slot * {ranges} div {max(1, length)} AS INT)"))
    return rows.repartition(shuffle_parts(docs.sparkSession), "__range").sortWithinPartitions("__slot", "__src", "doc_id").select(*docs.columns)
