"""Registered queries: each runs one operator over the driver's tables."""

from fraudwatch.catalog import (  # noqa: F401
    archive_queries,
    corpus_queries,
    model_queries,
    score_queries,
    source_queries,
    stream_queries,
)
from fraudwatch.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
