"""The book of registered queries: a decorator that pairs a plan with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobtide.sources.views import SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register ``f(views) -> DataFrame`` under its name; ``sql`` continues the SQL of the views."""

    def add(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (SQL.rstrip() + sql) if sql.lstrip().startswith(",") else SQL + sql
        return f

    return add
