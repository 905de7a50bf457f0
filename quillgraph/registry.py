"""Registered queries of the graph and search operators, with their DuckDB twins."""

from __future__ import annotations

from . import catalog_claims, catalog_index, catalog_memory, catalog_paths, catalog_policy, catalog_records, catalog_streamed  # noqa: F401  register their queries
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
