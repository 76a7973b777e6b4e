"""All queries outside of llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.plans import attribution, base, cleaning, eda, extensions, files, training


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of the test works by their nearest train document."""
    return attribution.nearest_authors(spark, sf_dir)


__all__ = ["attribution", "cleaning", "eda", "entry", "extensions", "files", "oracle_sql", "queries", "training"]
