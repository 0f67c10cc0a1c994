"""Constants of retrieval, graph expansion, budgets and state.

Fixed values: results depend on them, so they equal those of the system whose
queries this engine answers.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

CHUNK_TOKENS = {"WAC": 2000, "RCW": 2000, "SMC": 2000, "Seattle DIR": 2000, "IBC-WA": 2000, "SPU": 2000, "WA Court Opinions": 3000, "Governor Orders": 2000}
AUTHORITY_OF = {"WAC": "state_admin_rule", "RCW": "state_statute", "SMC": "local_statute", "Seattle DIR": "local_admin_rule", "IBC-WA": "state_admin_rule", "SPU": "guidance", "WA Court Opinions": "court_opinion", "Governor Orders": "state_executive_order"}
AUTHORITY_RANK = {"federal": 0, "state_statute": 1, "state_admin_rule": 2, "state_executive_order": 3, "court_opinion": 4, "local_statute": 5, "local_admin_rule": 6, "guidance": 7}
UNKNOWN_RANK = 99

VECTOR_K, BM25_K, RETRIEVAL_K = 30, 30, 15
LEVEL_K = {"L1": 8, "L2": 12, "L3": 20, "L4": 30, "L5": 35, "L6": 20}
FUSION_WEIGHTS = {"vector": 0.55, "bm25": 0.45}
RRF_WEIGHTS, RRF_K = {"vector": 0.5, "bm25": 0.25, "graph": 0.25}, 60
BM25_K1, BM25_B = 1.2, 0.75

EDGE_WEIGHTS = {"IMPLEMENTS": 0.75, "SUBJECT_TO": 0.70, "DEFINED_BY": 0.65, "AMENDED_BY": 0.60, "CITES": 0.35}
EDGE_TYPES = ("CITES", "IMPLEMENTS", "SUBJECT_TO", "DEFINED_BY", "AMENDED_BY", "NEXT_SECTION", "CONFLICTS_WITH", "AGENCY_HAS_DOC", "DOC_HAS_CHUNK")
NEXT_THRESHOLD, NEXT_HOPS = 0.35, 5
MAX_NEIGHBORS, MAX_ADDITIONS, MAX_ADDITIONS_L12, EXPAND_SEEDS = 3, 10, 5, 5
BFS_PRIORITY, BFS_LIMIT = {"IMPLEMENTS": 0, "SUBJECT_TO": 1, "CITES": 2}, 50
BEAM_WIDTH, BEAM_DEPTH, BEAM_DECAY, HUB_ALPHA = 10, 3, (1.0, 0.7, 0.45), 1.0

CONFLICT_MAX, CONFLICT_COSINE, CONFLICT_SEEDS, CONFLICT_PER_SEED, CONFLICT_RESERVE = 5, 0.55, 3, 3, 5
PAIR_NEIGHBORS, PAIR_COSINE = 5, 0.90
CONTEXT_TOKENS = 40_000
STRONG, INFERRED = 0.8, 0.5
MMR_LAMBDA, NOVELTY = 0.7, 0.20

SESSION_MINUTES, SESSION_TURNS, SESSION_CHUNKS = 60, 5, 100
TRACE_DAYS, MAX_CONVERSATIONS, TRACE_BYTES = 90, 500, 50 * 1024
CACHE_DECAY = 0.8
MIN_CHUNK_TOKENS = 20
EMBED_PRICE = 0.13  # dollars a million tokens
MAX_RETRIEVALS = 12
LEVEL_DEPTH = {"L3": 3, "L4": 4, "L5": 4, "L6": 3}


def weights_from(text: str | None, default: Mapping[str, float]) -> dict[str, float]:
    """``K:v,K:v`` over the defaults; parts that do not parse are ignored."""
    out = dict(default)
    for part in (text or "").split(","):
        name, colon, value = part.partition(":")
        try:
            if colon:
                out[name.strip()] = float(value.strip())
        except ValueError:
            continue
    return out


def override(variable: str, default: Mapping[str, float]) -> dict[str, float]:
    return weights_from(os.getenv(variable), default)
