"""Queries on entries that an earlier one already described (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import incremental
from lodestrata.runtime import table


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.concat(F.array("source.url"), F.coalesce(F.col("facts.source.url"), F.array().cast("array<string>")))
    return incremental.read(table(spark, sf_dir, "watchlist"), "watch_no", "batch_no", "name", "operator", "municipality", "country", "coordinates.lat", "coordinates.lon", pages)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated entry with the first one of its project."""
    return incremental.duplicates(entries(spark, sf_dir)).distinct()


QUERIES = {f.__name__: f for f in (p6_found,)}
ORACLE: dict[str, str] = {}
