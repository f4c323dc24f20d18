"""Where query modules put their queries, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkbooks.plans.inputs import derived, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None) -> Callable:
    """Registers a function of the named tables, given or derived, as a query; sql names the same tables."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[derived(spark, sf_dir, t) for t in tables])
        if sql:
            SQL[name] = oracle(sql, *tables)
        return f

    return add
