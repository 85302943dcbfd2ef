"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobtide.plans import matching, relational, resumes, texts  # noqa: F401
from jobtide.plans.book import ORACLES, QUERIES
from jobtide.sources.views import Views


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.flagship(Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
