"""Registry of the engine's own queries."""

from __future__ import annotations

from .plans import alignment, checks, composites, metrics, reports, selection, studies, text

MODULES = [metrics, text, selection, checks, reports, studies, composites, alignment]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
