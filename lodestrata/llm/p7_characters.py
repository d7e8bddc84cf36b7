"""Queries on visually identical text (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.plain_text import not_plain
from lodestrata.runtime import table

#: Where each field is: tab -> (key, text).
FIELDS = {"watchlist": ("watch_no", "municipality"), "scores": ("id", "name"), "indicators": ("row_no", "source.title")}


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that was not in the plain form, with its plain form."""
    out = None
    for tab, (key, text) in FIELDS.items():
        part = not_plain(table(spark, sf_dir, tab), F.col(key), F.col(text)).select(F.lit(tab).alias("tab"), "row_key", "value", "plain")
        out = part if out is None else out.unionByName(part)
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose value was not in the plain form."""
    return p7_values(spark, sf_dir).select("tab", "row_key").distinct()


QUERIES = {f.__name__: f for f in (p7_found, p7_values)}
ORACLE: dict[str, str] = {}
