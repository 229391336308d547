"""Names of the queries, their callables and their SQL."""

from __future__ import annotations

from ravine.plans import desk_queries, signal_queries  # noqa: F401  (register their queries and SQL)
from ravine.plans.oracles import ORACLE_SQL
from ravine.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
