"""The registry of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of `Tables` as a query; ``sql`` is what DuckDB runs for the same rows."""

    def register(make: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return make

    return register
