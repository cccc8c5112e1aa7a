"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import ORACLE, QUERIES, asked, chains, corpora, functions, graphs, posts, profiles, relations, rosters, searches, versions  # noqa: F401  (modules register as they load)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["r2_prefix"](spark, sf_dir)
