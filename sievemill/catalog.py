"""Registered queries of the core library, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows can be compared with a test's own model."""

    def add(make: Query) -> Query:
        QUERIES[name] = make
        if sql is not None:
            SQL[name] = sql
        return make

    return add


from .plans import corpus_queries, entity_queries, evaluation_queries, io_queries, relational_queries  # noqa: E402, F401  (they register themselves)
