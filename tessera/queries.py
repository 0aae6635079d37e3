"""All registered queries of the core, with their SQL for DuckDB."""

from __future__ import annotations

from .plans import catalogue, composite, facets, graph, ingest, memory, quality, search, sources, streams, texts  # noqa: F401  (importing registers them)
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
