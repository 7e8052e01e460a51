"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import file_queries, raster_queries, vector_queries

_GROUPS = (vector_queries, raster_queries, file_queries)
QUERIES = {name: f for g in _GROUPS for name, f in g.QUERIES.items()}
SQL = {name: sql for g in _GROUPS for name, sql in g.SQL.items()}
