"""Every query by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from ledgerlens.plans import queries_core, queries_cross, queries_graph, queries_match, queries_newsroom, queries_pages, queries_reports, queries_sources  # noqa: F401
from ledgerlens.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
