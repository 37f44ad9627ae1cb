"""All queries of the core, and their SQL."""

from __future__ import annotations

from pagewright.plans import core_queries, core_sql, nested_queries

_MODULES = (core_queries, nested_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {**core_sql.SQL, **nested_queries.SQL}
