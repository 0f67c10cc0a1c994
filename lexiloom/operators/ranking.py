"""Reranking, deduplication, diversity, budgets and answer-side signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AUTHORITY_RANK, CACHE_DECAY, CONTEXT_TOKENS, INFERRED, LEVEL_K, MMR_LAMBDA, NOVELTY, STRONG, UNKNOWN_RANK
from ..functions import cosine, lookup

# The order in which results of a source are given up under a token budget.
TIERS = {"conflict_expand": 0, "graph_expand": 1, "cache": 2, "graph": 3, "bm25": 4, "vector": 5}
UNKNOWN_TIER = 3


def rerank(results: DataFrame, vectors: DataFrame, query: list[float], level: str = "L2") -> DataFrame:
    """Scores results by cosine to a reference vector (0 where a result has none), best first, cut to
    the level's budget; scores are non-negative and rounded to 4 places."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.select("id", cosine(F.col("vector"), q).alias("__cos"))
    rows = results.join(near, "id", "left").withColumn("__raw", F.coalesce("__cos", F.lit(0.0)))
    rows = rows.orderBy(F.desc("__raw"), "id").limit(LEVEL_K.get(level, LEVEL_K["L2"]))
    return rows.withColumn("score", F.round(F.greatest("__raw", F.lit(0.0)), 4)).drop("__cos", "__raw")


def rerank_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, score and rank before and after, change of rank; dropped rows have none after."""
    rank = lambda: F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # noqa: E731  both sides are budgets of at most a few dozen rows
    b = before.select("id", F.col("score").alias("score_before"), rank().alias("rank_before"))
    a = after.select("id", F.col("score").alias("score_after"), rank().alias("rank_after"))
    return b.join(a, "id", "left").withColumn("change", F.col("rank_before") - F.col("rank_after")).withColumn("kept", F.col("rank_after").isNotNull())


def merge_leaves(rows: DataFrame) -> DataFrame:
    """One row an id over leaves (pos gives the order of rows): the best score, at equal scores
    the earlier row; sources of the winner first, each once."""
    order = F.struct(-F.col("score"), F.col("pos"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p"), F.col("sources").alias("sources"))))
    return rows.groupBy("id").agg(
        F.max("score").alias("score"), F.min_by("pos", order).alias("pos"), F.array_distinct(F.flatten(F.transform(parts, lambda x: x["sources"]))).alias("sources")
    )


def merge_cache(results: DataFrame, cached: DataFrame, decay: float = CACHE_DECAY) -> DataFrame:
    """Results and the cached rows that are not among them, at a lower score."""
    more = cached.join(results.select("id"), "id", "left_anti").select("id", (F.col("score") * decay).alias("score"), F.array(F.lit("cache")).alias("sources"))
    return results.select("id", "score", "sources").unionByName(more)


def authority_rank(level: Column) -> Column:
    return lookup(AUTHORITY_RANK, level, UNKNOWN_RANK)


def authority_order(rows: DataFrame) -> DataFrame:
    """Adds n, the place by authority (highest first), score and id."""
    n = F.row_number().over(Window.orderBy(authority_rank(F.col("authority_level")), F.desc("score"), "id"))  # a result list, not a corpus
    return rows.withColumn("n", n)


def diverse(rows: DataFrame, k: int, key: list[str], lam: float = MMR_LAMBDA, by: tuple[str, ...] = ()) -> DataFrame:
    """Maximal marginal relevance where similarity is equality of key: a row is penalised exactly
    if it is not the best of its key, so two windows replace the greedy loop."""
    first = F.row_number().over(Window.partitionBy(*by, *key).orderBy(F.desc("score"), "id"))
    value = F.col("score") if lam >= 1 else lam * F.col("score") - F.when(first > 1, 1 - lam).otherwise(0.0)
    rows = rows.withColumn("value", value)
    if not by:
        return rows.orderBy(F.desc("value"), F.desc("score"), "id").limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def section_key(citation: Column, section: Column, agency: Column, id_: Column) -> Column:
    """Key of a section: citation, section number (else the citation's last token) and agency, or the id alone."""
    number = F.coalesce(F.when(F.length(section) > 0, section), F.regexp_extract(citation, r"(\S+)\s*$", 1))
    return F.when(F.length(F.trim(citation)) > 0, F.struct(citation.alias("a"), number.alias("b"), agency.alias("c"))).otherwise(F.struct(id_.cast("string").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")))


def unigrams(text: Column) -> Column:
    """Distinct lower-cased words of at least 3 letters or digits."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) >= 3))


def drop_repeated_sections(rows: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """rows(id, doc, section, text, seed, pos): seeds stay; another row goes if its (doc, section) has a
    winner - the last seed, else the first row - and at most ``novelty`` of its words are new against it."""
    key = Window.partitionBy("doc", "section")
    seed = F.max_by(F.when(F.col("seed"), F.struct("id", "text")), F.when(F.col("seed"), F.col("pos"))).over(key)
    other = F.min_by(F.struct("id", "text"), F.col("pos")).over(key)
    rows = rows.withColumn("w", F.coalesce(seed, other))
    own = unigrams(F.col("text"))
    new = F.when(F.size(own) > 0, F.size(F.array_except(own, unigrams(F.col("w.text")))) / F.size(own)).otherwise(0.0)
    stays = F.col("seed") | (F.col("w.id") == F.col("id")) | (new > novelty)
    return rows.withColumn("novelty", new).where(stays).drop("w")


def tier(sources: Column) -> Column:
    """The best tier among a row's sources."""
    known = F.transform(sources, lambda s: lookup(TIERS, s, UNKNOWN_TIER))
    return F.coalesce(F.array_max(known), F.lit(UNKNOWN_TIER))


def token_budget(rows: DataFrame, most: int = CONTEXT_TOKENS, reserve: int = 0, order: str = "compat", by: tuple[str, ...] = ()) -> DataFrame:
    """rows(id, score, sources, tokens), with ``trimmed`` and ``reserved``.

    Rows go in order of tier until what is left fits; within a tier the highest
    score goes first (``order='documented'``: the lowest).  Up to ``reserve`` conflict
    rows are exempt and do not count."""
    conflict = F.array_contains("sources", "conflict_expand")
    nth = F.row_number().over(Window.partitionBy(*by, conflict).orderBy(F.desc("score"), "id"))
    rows = rows.withColumn("reserved", conflict & (nth <= reserve)).withColumn("tier", tier(F.col("sources")))
    cost = F.when(F.col("reserved"), 0).otherwise(F.col("tokens"))
    first = F.desc("score") if order == "compat" else F.asc("score")
    every = Window.partitionBy(*by)
    before = every.orderBy(F.col("reserved"), "tier", first, "id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(cost).over(every) - F.coalesce(F.sum(cost).over(before), F.lit(0))
    return rows.withColumn("trimmed", ~F.col("reserved") & (left > most))


def knapsack(rows: DataFrame, budget: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Greedy by score over cost, then score; an item that does not fit is passed over.

    One fold over a query's sorted items (its candidates, not a corpus)."""
    item = F.struct((-F.col("score") / F.greatest(F.col("cost"), F.lit(1))).alias("ratio"), (-F.col("score")).alias("neg"), "id", "cost", "score")
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda acc, x: F.when(acc["used"] + x["cost"] <= budget, F.struct((acc["used"] + x["cost"]).alias("used"), F.array_append(acc["ids"], x["id"]).alias("ids"))).otherwise(acc)
    picked = lists.select(*by, F.aggregate("items", start, step).alias("p"))
    return picked.select(*by, "p.used", F.explode("p.ids").alias("id"))


def compose(seeds: DataFrame, expansions: DataFrame, budget: int, preamble: int) -> DataFrame:
    """id, included: preamble first, seeds in order while they fit, then the knapsack over novel expansions.

    seeds(id, pos, cost, doc, section, text), expansions(id, pos, cost, score, doc, section, text)."""
    start = F.struct(F.lit(preamble).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda acc, x: F.when(acc["used"] + x["cost"] <= budget, F.struct((acc["used"] + x["cost"]).alias("used"), F.array_append(acc["ids"], x["id"]).alias("ids"))).otherwise(acc)
    kept = seeds.agg(F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "id", "cost"))), start, step).alias("p"))
    chosen = kept.select(F.explode("p.ids").alias("id"))
    won = seeds.join(chosen, "id").select("id", "doc", "section", "text", F.lit(True).alias("seed"), "pos")
    novel = drop_repeated_sections(won.unionByName(expansions.select("id", "doc", "section", "text", F.lit(False).alias("seed"), (F.col("pos") + 1_000_000).alias("pos")))).where("not seed").select("id")
    item = F.struct((-F.col("score") / F.greatest(F.col("cost"), F.lit(1))).alias("ratio"), (-F.col("score")).alias("neg"), "id", "cost")
    items = expansions.join(novel, "id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    ids = kept.crossJoin(items).select(F.aggregate("items", F.struct(F.col("p.used").alias("used"), F.col("p.ids").alias("ids")), step)["ids"].alias("ids"))  # two single rows
    everything = seeds.select("id").union(expansions.select("id"))
    return everything.join(ids.select(F.explode("ids").alias("id"), F.lit(True).alias("included")), "id", "left").withColumn("included", F.coalesce("included", F.lit(False)))


def first_and_last(text: Column) -> Column:
    """First and last sentence; a text of at most two sentences whole."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9\[\(\"])")
    return F.when(F.size(parts) <= 2, text).otherwise(F.concat_ws(" ", F.element_at(parts, 1), F.element_at(parts, -1)))


def context_blocks(rows: DataFrame, excerpt: int = 200) -> DataFrame:
    """n, id, block: results in order of authority as numbered excerpts."""
    text = F.concat_ws(" ", F.format_string("[%d]", F.col("n")), F.col("citation"), F.concat(F.lit("("), F.col("agency"), F.lit(")")), F.substring("text", 1, excerpt))
    return authority_order(rows).select("n", "id", F.when(F.array_contains("sources", "conflict_expand"), F.concat(F.lit("[conflict] "), text)).otherwise(text).alias("block"))


def sources_summary(rows: DataFrame) -> DataFrame:
    """One row: "1. citation (agency); 2. ..." in order of n."""
    return rows.agg(F.expr("listagg(concat(CAST(n AS STRING), '. ', citation, ' (', agency, ')'), '; ') WITHIN GROUP (ORDER BY n)").alias("summary"))


def hierarchy_callouts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """First citations (by n) of statute, state rule and local level, where two meet."""
    first = lambda names: F.min_by(F.when(F.col("authority_level").isin(names), F.col("citation")), F.when(F.col("authority_level").isin(names), F.col("n")))
    out = rows.groupBy(*by).agg(first(["state_statute"]).alias("statute"), first(["state_admin_rule"]).alias("rule"), first(["local_statute", "local_admin_rule"]).alias("local"))
    return out.withColumn("rule_under_statute", F.col("statute").isNotNull() & F.col("rule").isNotNull()).withColumn("local_under_statute", F.col("statute").isNotNull() & F.col("local").isNotNull())


def conflict_signal(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Groups with two or more strong results of two or more agencies whose authority differs by 3 ranks or more."""
    rank = authority_rank(F.col("authority_level"))
    out = rows.where("score > 0.5").groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("agency").alias("n_agencies"), (F.max(rank) - F.min(rank)).alias("spread"), F.array_join(F.array_sort(F.collect_set("agency")), ", ").alias("agencies"))
    return out.where("n >= 2 and n_agencies >= 2 and spread >= 3")


def confidence(score: Column) -> Column:
    return F.when(score > STRONG, "strongly_supported").when(score >= INFERRED, "reasonably_inferred").otherwise("uncertain")


def relative_confidence(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Confidence against the best score of the list: from 0.7 high, from 0.4 medium."""
    ratio = F.col("score") / F.max("score").over(Window.partitionBy(*by))
    return rows.withColumn("ratio", ratio).withColumn("confidence", F.when(ratio >= 0.7, "high").when(ratio >= 0.4, "medium").otherwise("low"))


CLAIM = r"\[((?:RCW|WAC|SMC|DR|EO|IBC|SPU)\s[^\]\[]+)\]"


def claims(answers: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answer_id, citation, n, pos, source_id, score) of bracketed citations that are among the sources,
    with the best-scored source; and (answer_id, citation) of those that are not."""
    found = answers.select("answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(CLAIM), 1)).alias("pos", "citation"))
    found = found.groupBy("answer_id", "citation").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    best = sources.groupBy("citation").agg(F.max_by("id", F.struct(F.col("score"), -F.col("id"))).alias("source_id"), F.max("score").alias("score"))
    return found.join(best, "citation"), found.join(best, "citation", "left_anti").select("answer_id", "citation")


def preamble(seeds: DataFrame, paths: DataFrame, by: str = "query_id", citations: int = 8, edges: int = 6) -> DataFrame:
    """``by``, preamble: how many seeds, their first citations, and the best terminal of each edge type in order of appearance.

    seeds(by, pos, citation), paths(by, pos, edge_type, chunk_id, score); only ``citations`` and ``edges`` rows of a query are gathered."""
    count = seeds.groupBy(by).agg(F.count("*").alias("n"))
    nth = lambda order: F.row_number().over(Window.partitionBy(by).orderBy(order))
    listed = lambda rows, value: rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(value).alias("x")))), lambda s: s["x"]).alias(value))
    cited = listed(seeds.where("citation <> ''").withColumn("nth", nth("pos")).where(F.col("nth") <= citations), "citation")
    kinds = paths.where("edge_type <> ''").groupBy(by, "edge_type").agg(F.min("pos").alias("pos"), F.max_by("chunk_id", F.struct(F.coalesce("score", F.lit(0.0)), -F.col("pos"))).alias("terminal"))
    kinds = kinds.withColumn("nth", nth("pos")).where(F.col("nth") <= edges)
    chains = listed(kinds.withColumn("chain", F.concat("edge_type", F.lit(" chain to "), F.coalesce(F.col("terminal").cast("string"), F.lit("?")), F.lit("."))), "chain")
    rows = count.join(cited, by, "left").join(chains, by, "full")
    head = F.concat(F.lit("Evidence graph: "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" seeds"), F.coalesce(F.concat(F.lit(" ("), F.array_join("citation", ", "), F.lit(")")), F.lit("")), F.lit("."))
    return rows.select(by, F.concat_ws(" ", head, F.array_join("chain", " ")).alias("preamble"))
