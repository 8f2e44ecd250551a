"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import aggregate_queries, graph_queries, metric_queries, retrieval_queries, source_queries, stream_queries, temporal_queries, text_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
