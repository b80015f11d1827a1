"""All queries and oracle statements by name."""

from __future__ import annotations

from . import other_queries, pair_queries, text_queries, time_queries

_MODULES = (text_queries, pair_queries, time_queries, other_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
