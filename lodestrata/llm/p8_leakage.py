"""Queries on evaluation texts in the corpus (p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.leakage import leaks
from lodestrata.runtime import table


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each item that leaked into it, and how much of it."""
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents concerned, with the item that leaked."""
    return p8_passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each suite leaked."""
    found = p8_passages(spark, sf_dir).select("doc_id", "item_id").distinct()
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite").distinct()
    return found.join(items, "item_id").groupBy("suite").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p8_found, p8_passages, p8_items)}
ORACLE: dict[str, str] = {}
