"""Constants of the operators, passed to them; never global state of a session."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # retrieval
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    vector_top_k: int = 30
    bm25_top_k: int = 20
    rerank_top_n: int = 10
    full_scan_max: int = 500
    prefilter_bm25: int = 200
    prefilter_recent: int = 200
    graph_hops: int = 1
    graph_cap: int = 30
    prior_seed: float = 0.2
    prior_related: float = 0.1
    prior_recency: float = 0.05
    # confidence
    confidence_high: float = 0.8
    confidence_mid: float = 0.5
    # context
    recent_window: int = 3
    section_max: int = 120
    extras_budget: int = 800
    # archive
    inactive_after: int = 50
    resolved_after: int = 20
    review_after: int = 50
    # health
    segment: int = 100
    streak_limit: int = 5
    gap_fire: int = 10
    gap_constellation: int = 15


DEFAULT = Config()
