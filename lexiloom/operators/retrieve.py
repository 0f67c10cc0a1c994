"""Hybrid retrieval: vector and text search, linear fusion, then metadata for the winners."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BM25_K, FUSION_WEIGHTS, RETRIEVAL_K, VECTOR_K
from .fusion import linear_fuse, top
from .search import bm25_topk, vector_topk


def hybrid(vectors: DataFrame, chunks: DataFrame, vector: list[float], text: str, k: int = RETRIEVAL_K, agencies: list[str] | None = None, valid: list[str] | None = None, weights: Mapping[str, float] = FUSION_WEIGHTS) -> DataFrame:
    """The k best chunks with score, sources and the chunks' own columns.

    Both searches rank (id, score) alone; the wide columns are read for k ids, which
    are broadcast (at most k rows)."""
    v = vector_topk(vectors, vector, VECTOR_K, agencies, valid).select(F.lit("vector").alias("source"), "id", "score")
    b = bm25_topk(chunks, text, BM25_K, agencies, valid).select(F.lit("bm25").alias("source"), "id", "score")
    best = top(linear_fuse(v.union(b), weights), k)
    return chunks.join(F.broadcast(best), "id")


def citation_path(agency: Column, citation: Column, parent: Column) -> Column:
    """agency, document (the parent, else the citation's chapter) and section of a chunk."""
    chapter = F.when(citation.rlike(r"-[^-]*$"), F.regexp_replace(citation, r"-[^-]*$", "")).when(citation.rlike(r"\.[^.]*$"), F.regexp_replace(citation, r"\.[^.]*$", ""))
    return F.struct(agency.alias("agency"), F.coalesce(F.when(F.length(parent) > 0, parent), chapter, citation).alias("document"), citation.alias("section"))
