"""Every operator re-stated on the given tables, with its SQL counterpart.

Customers stand for samples, parts for variants, (customer, part) purchases for
stored calls, orders for condition records, events for survey answers and
alignment records, and documents with labels for scored, labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when SQL can say the same, its SQL text."""
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return add
