"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annalist.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of a reader of tables under its name; None where SQL cannot express it."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: table(spark, d, name))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
