"""Queries on spellings of organisations and persons (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import spellings
from lodestrata.runtime import cut, table


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct spelling, with its own words."""
    operators = table(spark, sf_dir, "scores").select("operator").unionByName(table(spark, sf_dir, "sample_sites").select("operator")).distinct()
    carried = table(spark, sf_dir, "watchlist").select("name").distinct()
    both = spellings.nodes_of(operators).unionByName(spellings.nodes_of(carried, only_promoters=True))
    return cut(both.distinct(), "named")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling and the one that stands for its group."""
    got = spellings.clusters(named(spark, sf_dir))
    return got.select("name", F.col("cluster").alias("organisation"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings that mean the same one."""
    got = cut(spellings.clusters(named(spark, sf_dir)).select("name", "cluster").distinct(), "clusters")
    a, b = got.withColumnRenamed("name", "name_a"), got.withColumnRenamed("name", "name_b")
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b").distinct()


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each name's own words, by cosine."""
    return spellings.nearest(cut(named(spark, sf_dir).select("node").distinct(), "nodes"))


QUERIES = {f.__name__: f for f in (p2_found, p2_clusters, p2_nearest)}
ORACLE: dict[str, str] = {}
