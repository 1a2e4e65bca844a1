"""All named queries (importing the modules registers them)."""

from __future__ import annotations

from guichet.plans import case_queries, catalog, operations_queries, request_queries, retrieval_queries, text_queries  # noqa: F401
from guichet.plans import stream_queries  # noqa: F401  (after the batch twins)


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracles() -> dict[str, str]:
    return dict(catalog.ORACLES)
