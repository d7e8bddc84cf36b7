"""Queries on projects that stand in two tables (p1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import linkage
from lodestrata.runtime import cut, table


def p1_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each watchlist entry with the score record of its project and a confidence."""
    watch = linkage.signatures(table(spark, sf_dir, "watchlist"), "watch_no", "name", "operator", "municipality", "country", "project_status")
    scores = linkage.signatures(table(spark, sf_dir, "scores"), "id", "name", "operator", "municipality", "country", "project_status")
    left, right = cut(linkage.read(watch, every_org=False), "left"), cut(linkage.read(scores, every_org=True), "right")
    found = linkage.match(left, right)
    return (
        watch.select(F.col("key").alias("watch_no"), F.col("sig").alias("a"))
        .join(found, "a")
        .join(scores.select(F.col("key").alias("score_id"), F.col("sig").alias("b")).distinct(), "b")
        .groupBy("watch_no", "score_id")
        .agg(F.max("posterior").alias("posterior"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches alone."""
    return p1_posteriors(spark, sf_dir).select("watch_no", "score_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_posteriors)}
ORACLE: dict[str, str] = {}
