"""Queries by name, each next to its SQL form."""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(fn)
        def run(spark: SparkSession, d: str) -> DataFrame:
            # Dates are compared as UTC on both sides.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, d)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
