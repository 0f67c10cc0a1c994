"""SimHash near-duplicates with BK-trees.

A document's fingerprint is the bitwise majority of its features' hashes.
Equal fingerprints are one class.  Two classes are linked at ``radius`` or
fewer differing bits; a document's component is the smallest doc_id reachable.

Features are word shingles (XXH64 of each occurrence), or the distinct words of
a text.  Shingle fingerprints of edited copies differ in many bits (of 293
pairs with five-word Jaccard of 0.8 or more, 0.3% lie within 2 bits), those of
distinct words in few (98.6% within 5), so ``near_copies`` uses the latter and
holds each link against a second fingerprint, of five-word shingles, whose
distance follows the shingles' similarity.  The links of shingle fingerprints
that ``dedup`` makes are its links too: most such pairs are near by words, but
not all (of 1,697 pairs of sf0.1, two are not).

Trees by shard: the 64 bits are cut into blocks so that any linked pair shares
a choice of them (3 blocks for radius 2: one is equal); a shard holds the
classes with equal bits there, and its BK-tree (children keyed by integer
Hamming distance to the parent) is searched only along edges within the
radius.  A shard goes to the task that holds its queries instead of being
broadcast: trees of a whole corpus have no size bound, and each query needs
only its own shards.  The number of blocks follows from the number of classes,
so that a shard of unrelated ones stays small at any size.

Hot shards: one with over ``tree_cap`` classes is dealt again by a further
block of the bits that are left, one of which is equal, which loses no link; a
shard that is still larger is split so within its task.  A shard gives one
link a class at most (to the least of its group), never all pairs.

Scale: the text is read once and never shuffled; what is shuffled is a few rows
of 32 bytes a class.  Components are found with tables in the shared folder.

Cases: null and empty texts have fingerprint zero and are linked like others;
texts of fewer words than a shingle are one shingle; repeated rows (equal
doc_id too) are returned each; a null doc_id never names a component unless it
has no other document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import free_bits, majority, masks, scheme, signed
from .common import map_arrow, save, shuffle_parts, slices
from .components import components

SEED = 42
SHINGLE_RADIUS = 2  # bits that linked fingerprints of three-word shingles differ in


def fingerprints(texts: list[str | None], width: int = 3) -> np.ndarray:
    """uint64 SimHash of each text: lower-cased A-Z, words between ASCII white space."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    hashes, starts, rows, n = [], [], [], 0
    for i, t in enumerate(texts):
        words = t.encode().lower().split() if t else []
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = np.concatenate([[0], ends[:-1] + 1])
        k = max(1, len(words) - width + 1)
        last = ends[width - 1 :] if len(words) >= width else ends[-1:]
        hashes.append(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first[:k].tolist(), last.tolist())), np.uint64, k))
        starts.append(n)
        rows.append(i)
        n += k
    if rows:
        out[rows] = majority(np.concatenate(hashes), np.array(starts))
    return out


_PUNCT = bytes(c for c in range(128) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(_PUNCT, b" " * len(_PUNCT))


def word_fingerprints(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """uint64 SimHashes of each text's distinct words, and of its distinct shingles of ``width`` words."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    out = np.zeros((2, len(texts)), np.uint64)
    for i, t in enumerate(texts):
        words = t.lower().encode().translate(_PLAIN).split() if t else []
        if words:
            shingles = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
            for row, features in enumerate((set(words), shingles)):
                out[row, i] = majority(np.fromiter(map(digest, features), np.uint64, len(features)), np.zeros(1, np.int64))[0]
    return out[0], out[1]


_FPS = ("fp", "fp2", "fp3")


def fingerprint_table(docs: DataFrame, width: int = 3, words: bool = False) -> DataFrame:
    """doc_id, id (of the class), fp, fp2 and fp3 (signed 64-bit) of every row, written to the shared folder.

    fp is of shingles, fp2 and fp3 zero; with ``words`` the three are of words, of five-word shingles and of shingles."""

    def run(batches):
        for b in slices(batches, 256):
            texts = b.column(1).to_pylist()
            fp, none = fingerprints(texts, width), np.zeros(len(texts), np.uint64)
            every = (*word_fingerprints(texts), fp) if words else (fp, none, none)
            yield {"doc_id": b.column(0), **{k: x.view(np.int64) for k, x in zip(_FPS, every)}}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = map_arrow(rows, run, "doc_id long, " + ", ".join(f"{k} long" for k in _FPS))
    return save(rows.withColumn("id", F.xxhash64(*_FPS) if words else F.col("fp")), "fingerprints")


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> list[int]:
        """Inserts a value; gives the indices of earlier values within the radius."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return []
        found, todo = [], [0]
        values, children = self.values, self.children
        while todo:
            k = todo.pop()
            d = (values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            kids = children[k]
            if kids:
                for e in range(d - radius, d + radius + 1):
                    if e in kids:
                        todo.append(kids[e])
        k = 0
        while True:
            d = (values[k] ^ value).bit_count()
            if d not in children[k]:
                children[k][d] = len(values)
                break
            k = children[k][d]
        values.append(value)
        children.append({})
        return found


def shard_links(rows: list[tuple[int, int, int]], radius: int, check: int, cap: int, bits: list[int]) -> list[tuple[int, int]]:
    """Links (id, least id) of the groups of one shard's rows (id, fp, fp2); ``bits``: positions that may differ."""
    if len(rows) > cap and len(bits) > radius + 1:
        out = []
        for part in np.array_split(np.array(bits), radius + 1):
            mask = int(sum(1 << int(b) for b in part))
            by: dict[int, list[tuple[int, int, int]]] = {}
            for r in rows:
                by.setdefault(r[1] & mask, []).append(r)
            rest = [b for b in bits if not mask >> b & 1]
            for group in by.values():
                if len(group) > 1:
                    out += shard_links(group, radius, check, cap, rest)
        return out
    rows = sorted(rows)  # so that the root of a group is its least
    tree, parent = BKTree(), list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, fp, fp2) in enumerate(rows):
        for j in tree.add(fp, radius):
            if (rows[j][2] ^ fp2).bit_count() <= check:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(r[0], rows[k][0]) for i, r in enumerate(rows) if (k := root(i)) != i]


def link_classes(classes: DataFrame, n: int, radius: int = 2, check: int = 64, tree_cap: int = 2048) -> DataFrame:
    """Links (a, b) that connect all ``n`` classes(id, fp, fp2) within the radius, and within ``check`` by fp2."""
    first = masks(*scheme(n, radius))
    second = []  # every first choice with one further part of what it leaves free
    for m in first:
        second += [m | int(sum(1 << int(b) for b in part)) for part in np.array_split(np.array(free_bits(m)), radius + 1)]
    every = first + second
    key = lambda k, m: F.struct(F.lit(k).alias("code"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value"))
    rows = classes.select("id", "fp", "fp2", F.explode(F.array(*[key(k, m) for k, m in enumerate(first)])).alias("k")).select("id", "fp", "fp2", "k.*")
    heavy = rows.groupBy("code", "value").count().where(F.col("count") > tree_cap).select("code", "value")
    light = rows.join(heavy, ["code", "value"], "left_anti").select("id", "fp", "fp2", "code", "value")
    more = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda p: F.col("code") * (radius + 1) + p)
    finer = F.array(*[F.lit(signed(m)) for m in second])
    split = rows.join(heavy, ["code", "value"]).select("id", "fp", "fp2", F.explode(more).alias("k"))
    split = split.select("id", "fp", "fp2", (F.col("k") + len(first)).alias("code"), F.col("fp").bitwiseAND(F.element_at(finer, F.col("k") + 1)).alias("value"))

    def run(batches):
        held: list[tuple] = []
        key = None

        def links():
            if sum(len(x[0]) for x in held) > 1:
                ids, fps, fps2 = (np.concatenate(c) for c in zip(*held))
                rows = list(zip(ids.tolist(), fps.view(np.uint64).tolist(), fps2.view(np.uint64).tolist()))
                got = shard_links(rows, radius, check, tree_cap, free_bits(every[int(key[0])]))
                if got:
                    ab = np.array(got, np.int64)
                    yield {"a": ab[:, 0], "b": ab[:, 1]}

        for b in batches:
            i, fp, fp2, code, value = (b.column(k).to_numpy() for k in range(5))
            if not len(fp):
                continue
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (value[1:] != value[:-1])) + 1
            edges = np.concatenate([[0], cuts, [len(fp)]])
            size = np.diff(edges)
            size[[0, -1]] = 2  # the first and last run may go on in another batch
            for k in np.flatnonzero(size > 1).tolist():
                s, e = edges[k], edges[k + 1]
                if key is not None and key != (code[s], value[s]):
                    yield from links()
                    held = []
                key = (code[s], value[s])
                held.append((i[s:e], fp[s:e], fp2[s:e]))
        if key is not None:
            yield from links()

    dealt = light.union(split).repartition(shuffle_parts(classes.sparkSession), "code", "value").sortWithinPartitions("code", "value")
    return map_arrow(dealt, run, "a long, b long")


def dedup(docs: DataFrame, radius: int = 2, width: int = 3, words: bool = False, check: int = 64) -> DataFrame:
    """doc_id, fp, component_id of every row; with ``words``, shingle fingerprints within SHINGLE_RADIUS link too."""
    fps = fingerprint_table(docs, width, words)
    classes = save(fps.groupBy("id", *_FPS).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "classes")
    rows, n = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    links = link_classes(classes, n, radius, check)
    if words:
        links = links.union(link_classes(classes.select("id", F.col("fp3").alias("fp"), F.lit(0).cast("long").alias("fp2")), n, SHINGLE_RADIUS))
    roots = components(links)
    rooted = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = save(named.select("id", "n", "component_id"), "named")
    # a class with many documents is a hot key of this join: those (at most 2,000, each over
    # 1 / 2,000 of all rows) are broadcast, the others are joined by shuffle
    often = F.col("n") > max(64, rows // 2000)
    by_hot = fps.join(F.broadcast(named.where(often).select("id", "component_id")), "id", "left")
    rest = by_hot.where("component_id is null").drop("component_id").join(named.where(~often).select("id", "component_id"), "id", "left")
    done = by_hot.where("component_id is not null")
    return done.select("doc_id", "fp", "component_id").union(rest.select("doc_id", "fp", "component_id"))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return dedup(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, radius: int = 5, check: int = 16) -> DataFrame:
    """doc_id, fp, component_id by fingerprints of distinct words, each link confirmed by five-word shingles,
    and by the links of three-word shingles that ``dedup`` makes, which need no such confirmation.

    A distance of 16 bits of 64 between shingle fingerprints is that of sets with a Jaccard similarity of
    about 0.5; sets at 0.8 lie at 10, so that the check passes what the sampling of bits spreads."""
    return dedup(docs, radius, words=True, check=check)


def keep_one(docs: DataFrame, radius: int = 5, check: int = 16) -> DataFrame:
    """The documents, one of each component of near copies: that with the smallest doc_id (of repeated rows
    of it, the one with the smallest hash of text)."""
    null = F.lit(-(1 << 63))
    key = lambda c: F.coalesce(F.col(c).cast("long"), null)
    marks = near_copies(docs, radius, check).where(key("doc_id") == key("component_id")).select(key("doc_id").alias("__id")).distinct()
    rows = docs.withColumn("__id", key("doc_id")).join(marks, "__id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return rows.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
