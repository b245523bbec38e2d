"""All registered queries with their oracle SQL, by operator."""

from __future__ import annotations

from tablemill.plans import analytics_queries, discovery_queries, ordered_queries, relational_queries, tool_queries
from tablemill.plans.base import Query
from tablemill.plans.relational_queries import flagship

__all__ = ["flagship", "oracle_sql", "queries"]

PARTS = (relational_queries.BOOK, tool_queries.BOOK, analytics_queries.BOOK, ordered_queries.BOOK, discovery_queries.BOOK)


def queries() -> dict[str, Query]:
    return {name: run for book in PARTS for name, (run, _) in book.entries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in PARTS for name, (_, sql) in book.entries.items() if sql}
