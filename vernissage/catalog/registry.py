"""Named queries over the test tables, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vernissage.catalog.views import Tables, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame`. `sql` may name views; without one there is no oracle."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        if name in QUERIES:
            raise ValueError(f"two queries called {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = duckdb_sql(sql)
        return fn

    return register
