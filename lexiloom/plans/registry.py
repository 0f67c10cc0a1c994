"""All registered queries outside the training-data operators."""

from __future__ import annotations

from . import answer_queries, chunk_queries, context_queries, graph_queries, search_queries, state_queries

MODULES = (search_queries, graph_queries, state_queries, chunk_queries, answer_queries, context_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
