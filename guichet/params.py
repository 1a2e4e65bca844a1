"""Job parameters. A plan is chosen from these values before it runs; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values: defaults of the business rules
    top_k: int = 4
    candidate_k: int = 20
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    chunk_size: int = 900
    chunk_overlap: int = 150
    min_confidence: float = 0.35
    coverage_weight: float = 0.6
    dense_floor: float = 0.25
    dense_span: float = 0.45
    max_quotes: int = 3
    min_score_share: float = 0.75
    excerpt_chars: int = 300
    dispute_threshold: float = 500.0
    dedupe_days: int = 7
    budget_eur: float = 0.02
    recent_requests: int | None = None  # rows of the log that the figures read; all of them unless given
    rate_limit: int = 60
    rate_window_s: int = 60
    hash_dim: int = 256
    business_timezone: str = "Europe/Paris"
    # physical choices (not business rules)
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 * 1024 * 1024
    query_block: int = 4096
    corpus_block: int = 1024
    hot_key_rows: int = 200_000
    block_width: int = 128  # documents of an index block
    bounded_from: int = 1_000_000  # documents of an index from which blocks are bounded before they are opened
    first_blocks: int = 4  # blocks of a question opened before the others are bounded


DEFAULTS = Params()
