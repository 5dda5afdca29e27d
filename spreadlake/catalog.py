"""Registered queries over the reference tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as _queries
from .plans import queries_reports, queries_sources, queries_validation  # noqa: F401  they register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-test of one pair, one row a trade."""
    return _queries.QUERIES["trades"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.ORACLES)
