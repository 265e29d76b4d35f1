"""All queries of the core."""

from __future__ import annotations

from strata.plans import graph_queries, history_queries, shape_queries, text_queries, vector_queries  # noqa: F401
from strata.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
