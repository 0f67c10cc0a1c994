"""Graph operators over edges (src, dst, rel_type, confidence): construction, traversal, expansion, conflicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    BEAM_DECAY,
    BEAM_WIDTH,
    BFS_LIMIT,
    BFS_PRIORITY,
    CONFLICT_COSINE,
    CONFLICT_MAX,
    CONFLICT_PER_SEED,
    EDGE_TYPES,
    EDGE_WEIGHTS,
    HUB_ALPHA,
    MAX_ADDITIONS,
    MAX_NEIGHBORS,
    NEXT_HOPS,
    NEXT_THRESHOLD,
)
from ..functions import cosine, lookup, unit
from .search import batch_knn


def next_edges(chunks: DataFrame) -> DataFrame:
    """Edges between chunks of a file whose index differs by exactly one."""
    w = Window.partitionBy("filename").orderBy("chunk_index", "id")
    rows = chunks.select("id", "chunk_index", F.lead("id").over(w).alias("dst"), F.lead("chunk_index").over(w).alias("n"))
    return rows.where("n = chunk_index + 1").select(F.col("id").alias("src"), "dst", F.lit("NEXT_SECTION").alias("rel_type"), F.lit(1.0).alias("confidence"))


def hierarchy(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Agencies (id, authority_level); documents (id, agency of the first chunk, label: the file's stem);
    edges agency -> document and document -> chunk as (parent, child, rel_type)."""
    agencies = chunks.groupBy(F.col("agency").alias("id")).agg(F.min("authority_level").alias("authority_level"))
    docs = chunks.groupBy(F.col("filename").alias("id")).agg(F.min_by("agency", F.struct("chunk_index", "id")).alias("agency"))
    docs = docs.withColumn("label", F.regexp_replace(F.regexp_extract(F.col("id").cast("string"), r"([^/]*)$", 1), r"\.[^.]*$", ""))
    up = docs.select(F.col("agency").cast("string").alias("parent"), F.col("id").cast("string").alias("child"), F.lit("AGENCY_HAS_DOC").alias("rel_type"))
    down = chunks.select(F.col("filename").cast("string").alias("parent"), F.col("id").cast("string").alias("child"), F.lit("DOC_HAS_CHUNK").alias("rel_type"))
    return agencies, docs, up.unionByName(down)


def edge_counts(edges: DataFrame) -> DataFrame:
    """rel_type, n for every edge type, 0 where there is none."""
    types = edges.sparkSession.createDataFrame([(t,) for t in EDGE_TYPES], "rel_type string")
    return types.join(edges.groupBy("rel_type").agg(F.count("*").alias("n")), "rel_type", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def in_degree(edges: DataFrame, types: Sequence[str] = tuple(EDGE_WEIGHTS)) -> DataFrame:
    return edges.where(F.col("rel_type").isin(list(types))).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, rel_type, confidence, out): every edge from either end."""
    forth = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type", "confidence", F.lit(True).alias("out"))
    return forth.union(edges.select("dst", "src", "rel_type", "confidence", F.lit(False)))


def two_hops(edges: DataFrame, seeds: DataFrame, limit: int = BFS_LIMIT, types: Mapping[str, int] = BFS_PRIORITY) -> DataFrame:
    """id, depth, rel_type, confidence: what lies within two hops of ``seeds(id)``, both hops of one type
    and direction; best by depth, confidence, type; seeds excluded; at most ``limit``."""
    walk = both_ways(edges.where(F.col("rel_type").isin(list(types))))
    one = seeds.join(walk, F.col("id") == F.col("a")).select("b", "rel_type", "confidence", "out")
    hop = one.groupBy("b", "rel_type", "out").agg(F.max("confidence").alias("confidence"))
    two = hop.alias("x").join(walk.alias("y"), (F.col("x.b") == F.col("y.a")) & (F.col("x.rel_type") == F.col("y.rel_type")) & (F.col("x.out") == F.col("y.out")))
    two = two.select(F.col("y.b").alias("id"), F.lit(2).alias("depth"), F.col("y.rel_type").alias("rel_type"), F.col("y.confidence").alias("confidence"))
    found = hop.select(F.col("b").alias("id"), F.lit(1).alias("depth"), "rel_type", "confidence").union(two)
    found = found.join(seeds, "id", "left_anti").withColumn("prio", lookup(types, F.col("rel_type")))
    best = found.groupBy("id").agg(F.min(F.struct("depth", (-F.col("confidence")).alias("neg"), "prio", "rel_type")).alias("m"))
    return best.select("id", "m.depth", "m.rel_type", (-F.col("m.neg")).alias("confidence"), "m.prio").orderBy("depth", F.desc("confidence"), "prio", "id").limit(limit).drop("prio")


def node_context(edges: DataFrame, nodes: DataFrame, ids: DataFrame, types: Sequence[str] = ("CITES", "IMPLEMENTS", "SUBJECT_TO", "DEFINED_BY")) -> DataFrame:
    """id, other, citation, rel_type, direction: edges at ``ids(id)`` with the other end's citation."""
    walk = both_ways(edges.where(F.col("rel_type").isin(list(types))))
    rows = ids.join(walk, F.col("id") == F.col("a")).select("id", F.col("b").alias("other"), "rel_type", F.when(F.col("out"), "out").otherwise("in").alias("direction"))
    return rows.join(nodes.select(F.col("id").alias("other"), "citation"), "other", "left").distinct()


def relationship_panel(edges: DataFrame, nodes: DataFrame, ids: DataFrame, most: int = 5) -> DataFrame:
    """id, panel (cites, cited_by, implements, subject_to), other, n: at most ``most`` a panel."""
    out = F.col("out")
    panel = F.when(out & F.col("rel_type").isin("CITES", "DEFINED_BY"), "cites").when(~out & (F.col("rel_type") == "CITES"), "cited_by").when(out & (F.col("rel_type") == "IMPLEMENTS"), "implements").when(out & (F.col("rel_type") == "SUBJECT_TO"), "subject_to")
    # no citation is shown, so edges are not joined with nodes; all that follows is by id, after one exchange
    walk = both_ways(edges.where(F.col("rel_type").isin("CITES", "IMPLEMENTS", "SUBJECT_TO", "DEFINED_BY"))).select(F.col("a").alias("id"), panel.alias("panel"), F.col("b").alias("other"))
    rows = walk.where("panel is not null").join(ids.select("id"), "id", "left_semi").distinct()
    n = F.row_number().over(Window.partitionBy("id", "panel").orderBy("other"))
    return rows.withColumn("n", n).where(F.col("n") <= most)


def hub_penalty(degree: Column, alpha: float = HUB_ALPHA) -> Column:
    return 1 / (1 + alpha * F.log1p(degree))


# Traversal profiles by intent (edge types, depth, factors on the default weights).
PROFILES = {
    "definition": (("DEFINED_BY", "CITES"), 1, {"DEFINED_BY": 1.2}),
    "authority_chain": (("IMPLEMENTS", "SUBJECT_TO"), 3, {"IMPLEMENTS": 1.5}),
    "cross_agency": (("IMPLEMENTS", "CITES", "SUBJECT_TO"), 2, {}),
    "procedural": (("NEXT_SECTION", "CITES"), 2, {}),
}
DEFAULT_PROFILE = (("CITES", "IMPLEMENTS", "SUBJECT_TO"), 2, {})
# Cosine below which a chain of sections ends, by prefix of the document type.
NEXT_THRESHOLDS = {"wac": 0.50, "rcw": 0.50, "smc": 0.50, "ibc": 0.40, "dir": 0.35, "spu": 0.35, "governor": 0.30, "court_opinion": 0.25, "court": 0.25}


def profile(intent: str | None) -> tuple[tuple[str, ...], int, dict[str, float]]:
    """Edge types, depth and weights of an intent: default weight (1 if none) times factor, 4 places."""
    types, depth, factor = PROFILES.get(intent or "", DEFAULT_PROFILE)
    return types, depth, {t: round(EDGE_WEIGHTS.get(t, 1.0) * factor.get(t, 1.0), 4) for t in types}


def beam(edges: DataFrame, vectors: DataFrame, seeds: DataFrame, query: list[float], intent: str | None = None, width: int = BEAM_WIDTH, decay: Sequence[float] = BEAM_DECAY) -> DataFrame:
    """id, score, depth, rel_type, seed, path: hop by hop the ``width`` best neighbours by cosine x weight x
    decay x hub penalty; best of each id over hops.  A hop is one plan over edges with a broadcast
    frontier of at most ``width`` rows; the loop has at most three hops, all lazy."""
    types, depth, weights = profile(intent)
    spark = edges.sparkSession
    q = F.array(*[F.lit(float(x)) for x in query])
    use = edges.where(F.col("rel_type").isin(list(types))).withColumn("w", lookup(weights, F.col("rel_type"), 1.0))
    near = vectors.select("id", cosine(F.col("vector"), q).alias("cos")).where("cos is not null")
    degree = in_degree(edges)
    front = seeds.select("id", F.col("id").alias("seed"), F.array().cast("array<struct<rel_type:string,id:bigint>>").alias("path"))
    out = None
    for hop in range(depth):
        step = use.join(F.broadcast(front), F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "rel_type", "w", "seed", "path")
        step = step.join(F.broadcast(seeds.select("id")), "id", "left_anti")
        best = step.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("neg"), "rel_type", "seed", "path")).alias("m"))
        scored = best.join(near, "id").join(degree, "id", "left")
        score = F.col("cos") * -F.col("m.neg") * float(decay[min(hop, len(decay) - 1)]) * hub_penalty(F.coalesce("in_degree", F.lit(0)))
        rows = scored.select("id", F.round(score, 9).alias("score"), F.lit(hop + 1).alias("depth"), "m.rel_type", "m.seed", F.array_append("m.path", F.struct(F.col("m.rel_type").alias("rel_type"), F.col("id").alias("id"))).alias("path"))
        kept = rows.orderBy(F.desc("score"), "id").limit(width).collect()  # the frontier: at most width rows
        front_rows = spark.createDataFrame(kept, rows.schema) if kept else spark.createDataFrame([], rows.schema)
        out = front_rows if out is None else out.union(front_rows)
        if not kept:
            break
        front = front_rows.select("id", "seed", "path")
    return out.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "depth", "rel_type", "seed", "path")).alias("m")).select("id", (-F.col("m.neg")).alias("score"), "m.depth", "m.rel_type", "m.seed", "m.path")


def next_chain(chunks: DataFrame, vectors: DataFrame, seeds: DataFrame, query: list[float], threshold: float = NEXT_THRESHOLD, hops: int = NEXT_HOPS) -> DataFrame:
    """id, seed, hop, score: neighbours in the file, up to ``hops`` each way, while each has a vector of
    cosine at or over the threshold.  Seeds themselves are skipped without ending the chain.  One join on
    (file, index), then a running break flag - no iteration.  ``vectors`` may hold cosines as ``score``
    in place of vectors, where many rows share one."""
    q = F.array(*[F.lit(float(x)) for x in query])
    at = seeds.join(chunks.select("id", "filename", "chunk_index"), "id").select(F.col("id").alias("seed"), "filename", "chunk_index")
    steps = F.array(*[F.lit(i) for i in range(-hops, hops + 1) if i])
    reach = at.withColumn("hop", F.explode(steps)).select("seed", "filename", (F.col("chunk_index") + F.col("hop")).alias("chunk_index"), "hop")
    near = vectors.select("id", F.col("score") if "score" in vectors.columns else cosine(F.col("vector"), q).alias("score"))
    rows = reach.join(chunks.select("id", "filename", "chunk_index"), ["filename", "chunk_index"], "left").join(near, "id", "left")
    rows = rows.join(seeds.select(F.col("id"), F.lit(True).alias("old")), "id", "left")
    stop = F.when(F.col("old"), 0).otherwise(F.when(F.col("score") >= threshold, 0).otherwise(1))
    w = Window.partitionBy("seed", F.col("hop") > 0).orderBy(F.abs("hop")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ended", F.max(stop).over(w)).where("ended = 0 and old is null").select("id", "seed", "hop", "score")


def expand(edges: DataFrame, vectors: DataFrame, seeds: DataFrame, query: list[float], chain: DataFrame | None = None, weights: Mapping[str, float] = EDGE_WEIGHTS, neighbors: int = MAX_NEIGHBORS, most: int = MAX_ADDITIONS) -> DataFrame:
    """id, score, rel_type: direct targets of seeds, at most ``neighbors`` of a seed and type (by confidence,
    then id), each by its heaviest edge, scored by cosine x weight; with the chain's rows; the ``most`` best."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = edges.where(F.col("rel_type").isin(list(weights))).join(F.broadcast(seeds.select(F.col("id").alias("src"))), "src")
    out = out.join(F.broadcast(seeds.select(F.col("id").alias("dst"))), "dst", "left_anti")
    n = F.row_number().over(Window.partitionBy("src", "rel_type").orderBy(F.desc("confidence"), "dst"))
    out = out.withColumn("n", n).where(F.col("n") <= neighbors).withColumn("w", lookup(weights, F.col("rel_type")))
    best = out.groupBy(F.col("dst").alias("id")).agg(F.max("w").alias("w"), F.max_by("rel_type", "w").alias("rel_type"))
    near = vectors.select("id", cosine(F.col("vector"), q).alias("cos")).where("cos is not null")
    rows = best.join(near, "id").select("id", (F.col("cos") * F.col("w")).alias("score"), "rel_type", F.lit(0).alias("late"))
    if chain is not None:
        more = chain.groupBy("id").agg(F.max("score").alias("score"))
        rows = rows.union(more.select("id", "score", F.lit("NEXT_SECTION"), F.lit(1)))
        rows = rows.groupBy("id").agg(F.min_by("score", "late").alias("score"), F.min_by("rel_type", "late").alias("rel_type"))
    return rows.select("id", "score", "rel_type").orderBy(F.desc("score"), "id").limit(most)


def threshold_for(keys: DataFrame, thresholds: Mapping[str, float], default: float = NEXT_THRESHOLD) -> DataFrame:
    """Adds ``threshold`` to keys(key): that of the longest lower-case prefix, else the default."""
    k = F.lower(F.trim("key"))
    out = F.lit(float(default))
    for name, value in sorted(thresholds.items(), key=lambda x: len(x[0])):
        out = F.when((k != "") & k.startswith(name.lower()), float(value)).otherwise(out)
    return keys.withColumn("threshold", out)


def fuse_seeds(leaves: DataFrame, vectors: DataFrame, per_leaf: int = 3) -> tuple[DataFrame, DataFrame]:
    """Seeds (id, leaf, rank) in order of first appearance over leaves(leaf, rank, id), and one row with
    the unit mean of their vectors (null if there is none or it is zero)."""
    seeds = leaves.where(F.col("rank") <= per_leaf).groupBy("id").agg(F.min(F.struct("leaf", "rank")).alias("m")).select("id", "m.leaf", "m.rank")
    parts = vectors.join(seeds.select("id"), "id").where("vector is not null").select(F.posexplode("vector").alias("d", "x"))
    mean = parts.groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    return seeds, vector.select(unit(F.col("v")).alias("vector"))


def shared_authority(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, seed, via: nodes of other agencies that implement what a seed implements; the smallest
    (seed, via) of each."""
    use = edges.where("rel_type = 'IMPLEMENTS'").select("src", "dst")
    own = use.join(F.broadcast(seeds.select(F.col("id").alias("src"))), "src").select(F.col("src").alias("seed"), F.col("dst").alias("via"))
    met = use.join(own, F.col("dst") == F.col("via")).select(F.col("src").alias("id"), "seed", "via").join(F.broadcast(seeds.select("id")), "id", "left_anti")
    agency = nodes.select("id", "agency")
    met = met.join(agency, "id").join(agency.select(F.col("id").alias("seed"), F.col("agency").alias("seed_agency")), "seed").where("agency <> seed_agency")
    return met.groupBy("id").agg(F.min(F.struct("seed", "via")).alias("m")).select("id", "m.seed", "m.via")


def cross_agency(vectors: DataFrame, seeds: DataFrame, per_seed: int = CONFLICT_PER_SEED, least: float = CONFLICT_COSINE) -> DataFrame:
    """id, seed, score: each seed's nearest rows of other agencies, by blocks of agency-free candidates."""
    mine = vectors.join(F.broadcast(seeds.select("id")), "id")
    rows = []
    for r in mine.select("agency").distinct().collect():  # agencies of a handful of seeds
        rows.append(batch_knn(mine.where(F.col("agency") == r[0]), vectors.where(F.col("agency") != r[0]), per_seed))
    out = rows[0] if rows else batch_knn(mine, vectors, per_seed)
    for r in rows[1:]:
        out = out.union(r)
    return out.where(F.col("score") >= least).select("id", F.col("query_id").alias("seed"), "score")


def conflict_expand(edges: DataFrame, nodes: DataFrame, vectors: DataFrame, seeds: DataFrame, query: list[float], most: int = CONFLICT_MAX, least: float = CONFLICT_COSINE) -> DataFrame:
    """id, tag, score: shared authority and cross-agency neighbours merged, by cosine to the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    a = shared_authority(edges, nodes, seeds).select("id", F.lit(True).alias("shared"))
    b = cross_agency(vectors, seeds, least=least).select("id", F.lit(True).alias("near")).distinct().join(seeds.select("id"), "id", "left_anti")
    both = a.join(b, "id", "full")
    tag = F.when(F.col("shared") & F.col("near"), "shared_authority+cross_agency").when(F.col("shared"), "shared_authority").otherwise("cross_agency")
    rows = both.withColumn("tag", tag).join(vectors.select("id", cosine(F.col("vector"), q).alias("score")), "id").where("score is not null")
    return rows.select("id", "tag", "score").orderBy(F.desc("score"), "id").limit(most)


def conflict_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: sources of different agencies that implement one target.

    The result is the pairs themselves; the join goes by target, so AQE splits a hot one."""
    use = edges.where("rel_type = 'IMPLEMENTS'").select("src", "dst").join(nodes.select(F.col("id").alias("src"), "agency"), "src")
    x, y = use.alias("x"), use.alias("y")
    met = x.join(y, (F.col("x.dst") == F.col("y.dst")) & (F.col("x.agency") < F.col("y.agency")))
    return met.select(F.least("x.src", "y.src").alias("a"), F.greatest("x.src", "y.src").alias("b")).distinct()


def expand_document(edges: DataFrame, chunks: DataFrame, document, loaded: list) -> tuple[DataFrame, DataFrame]:
    """Edges of a document's chunks into loaded documents (src, dst, rel_type), and counts of the others
    by (target document, rel_type)."""
    own = chunks.where(F.col("filename") == document).select(F.col("id").alias("src"))
    out = edges.join(own, "src").join(chunks.select(F.col("id").alias("dst"), F.col("filename").alias("target")), "dst").where(F.col("target") != document)
    inside = F.col("target").isin(loaded)
    return out.where(inside).select("src", "dst", "rel_type"), out.where(~inside).groupBy("target", "rel_type").agg(F.count("*").alias("n"))


def cross_document(edges: DataFrame, chunks: DataFrame, one, two) -> DataFrame:
    """Distinct edges between the chunks of two documents, either way."""
    file = chunks.select("id", "filename").where(F.col("filename").isin([one, two]))
    a, b = file.select(F.col("id").alias("src"), F.col("filename").alias("fa")), file.select(F.col("id").alias("dst"), F.col("filename").alias("fb"))
    return edges.join(a, "src").join(b, "dst").where("fa <> fb").select("src", "dst", "rel_type").distinct()


def neighbourhood(edges: DataFrame, ids: DataFrame, hops: int = 2) -> DataFrame:
    """id, hop: nodes within ``hops`` undirected hops, with the least hop."""
    walk = both_ways(edges).select("a", "b")  # repeated edges go with the distinct of what they reach
    reach = front = ids.select("id", F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        front = walk.join(front.select("id").distinct(), F.col("a") == F.col("id")).select(F.col("b").alias("id"), F.lit(h).alias("hop")).distinct()
        reach = reach.union(front)
    return reach.groupBy("id").agg(F.min("hop").alias("hop"))


def missing_ids(ids: DataFrame, nodes: DataFrame, sample: int = 5) -> DataFrame:
    """Of the first few ids, those that no node has."""
    return ids.orderBy("id").limit(sample).join(nodes.select("id"), "id", "left_anti")


# How edge types are drawn.
EDGE_STYLE = {"CITES": "solid", "IMPLEMENTS": "bold", "SUBJECT_TO": "dashed", "DEFINED_BY": "dotted", "AMENDED_BY": "dashed", "CONFLICTS_WITH": "bold", "NEXT_SECTION": "thin"}


def styled(edges: DataFrame) -> DataFrame:
    return edges.withColumn("style", lookup(EDGE_STYLE, F.col("rel_type"), "solid"))


def with_properties(nodes: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Nodes that have, of each property named, one of its values; a property without values filters nothing."""
    for name, values in wanted.items():
        if values:
            nodes = nodes.where(F.col(name).isin(values))
    return nodes
