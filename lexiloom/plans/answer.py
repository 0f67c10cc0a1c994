"""One question from retrieval to the context of an answer, as one composition of operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFLICT_RESERVE, CONTEXT_TOKENS, MAX_ADDITIONS, MAX_ADDITIONS_L12
from ..functions import token_count
from ..operators import graph, ranking
from ..operators.retrieve import hybrid


@dataclass
class Corpus:
    """chunks(id, text, agency, citation, authority_level), vectors(id, vector, agency), edges(src, dst, rel_type, confidence)."""

    chunks: DataFrame
    vectors: DataFrame
    edges: DataFrame


def context(corpus: Corpus, vector: list[float], text: str, level: str = "L3", conflicts: bool = True, most_tokens: int = CONTEXT_TOKENS) -> DataFrame:
    """n, id, score, sources, tokens, trimmed ... of the chunks that an answer is written from.

    Retrieve, rerank, expand along edges, add conflicts, trim to the token budget, order by authority.  All
    lists are bounded by the level, so windows without partition see at most a few dozen rows."""
    chunks = corpus.chunks
    found = hybrid(corpus.vectors, chunks, vector, text).select("id", "score", "sources")
    best = ranking.rerank(found, corpus.vectors, vector, level).select("id", "score", "sources")
    seeds = best.orderBy(F.desc("score"), "id").limit(5).select("id")
    most = MAX_ADDITIONS_L12 if level in ("L1", "L2") else MAX_ADDITIONS
    more = graph.expand(corpus.edges, corpus.vectors, seeds, vector, most=most).select("id", "score", F.array(F.lit("graph_expand")).alias("sources"))
    rows = best.unionByName(more.join(best.select("id"), "id", "left_anti"))
    if conflicts:
        against = graph.conflict_expand(corpus.edges, chunks, corpus.vectors, best.orderBy(F.desc("score"), "id").limit(3).select("id"), vector)
        rows = rows.unionByName(against.select("id", "score", F.array(F.lit("conflict_expand")).alias("sources")).join(rows.select("id"), "id", "left_anti"))
    wide = chunks.join(F.broadcast(rows), "id").withColumn("tokens", token_count(F.col("text")).cast("long"))
    reserve = CONFLICT_RESERVE if level not in ("L1", "L2") else 0
    kept = ranking.token_budget(wide, most_tokens, reserve).where("not trimmed")
    return ranking.authority_order(kept)


def sources_event(rows: DataFrame) -> DataFrame:
    """Rows as they are shown: score to 3 places, NaN in the path as null."""
    return rows.select("id", F.round("score", 3).alias("score"), "citation", F.when(F.col("section") != "NaN", F.col("section")).alias("section"))


def render(citation, agency, text):
    """A chunk as a block of a prompt."""
    return F.concat_ws("\n", F.concat(F.lit("["), citation, F.lit(" | "), agency, F.lit("]")), text)
