"""Registered queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from weftgraph.plans import bundle_queries, compare, detail_queries, expansion_queries, scalar_queries, snapshot, source_queries, syntax_queries, validation_queries, workspace_queries
from weftgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bundle_queries", "compare", "detail_queries", "expansion_queries", "scalar_queries", "snapshot", "source_queries", "syntax_queries", "validation_queries", "workspace_queries"]
