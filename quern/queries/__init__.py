"""Queries over the test tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def catalogue() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries, and the SQL of those that SQL can express."""
    from quern.queries import indexing, retrieval, service

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (indexing, retrieval, service):
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
