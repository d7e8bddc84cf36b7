"""Joins, merges and dedupes with explicit orders.

Wherever the first or last of several rows counts, the order is given by columns
and ends with a unique one, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the smallest in order; an aggregation, so hot keys combine
    before the shuffle."""
    cols = list(columns or [c for c in df.columns if c not in key])
    rest = [c for c in cols if c not in order]
    got = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return got.select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or [c for c in df.columns if c not in key])
    rest = [c for c in cols if c not in order]
    got = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return got.select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], fill: dict[str, object] | None = None) -> DataFrame:
    """Left join on a code; absent codes give null or the fill value."""
    out = df.join(dim, list(on), "left")
    for c, v in (fill or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    return a.join(b, key, "full_outer").where("_l is null or _r is null").select(key, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side"))


def merged(base: DataFrame, updates: DataFrame, key: str, keep: dict[str, Column], overwrite: Sequence[str]) -> DataFrame:
    """Insert or update: ``keep`` says how a column results from both sides (old
    columns as o_, new as n_), others are overwritten by the update."""
    cols = [c for c in base.columns if c != key]
    o = base.select(key, *[F.col(c).alias(f"o_{c}") for c in cols])
    n = updates.select(key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("_new"))
    both = o.join(n, key, "full_outer")
    new = F.col("_new").isNotNull()
    out = [F.col(key)]
    for c in cols:
        out.append((keep[c] if c in keep else F.when(new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) if c in overwrite else F.coalesce(f"o_{c}", f"n_{c}")).alias(c))
    return both.select(*out)


def padded(keys: DataFrame, labels: Sequence[object], label: str, facts: DataFrame, on: Sequence[str], fill: dict[str, object]) -> DataFrame:
    """Every key with every label of a fixed list, absent ones with defaults."""
    grid = keys.select("*", F.explode(F.array(*[F.lit(x) for x in labels])).alias(label))
    return lookup(grid, facts, on, fill)


def merge_sources(df: DataFrame, key: Column, order: Sequence[str], source: str, first: Sequence[str]) -> DataFrame:
    """Records of several feeds put together by key: the first record's fields, and
    all sources in order without repeats."""
    rows = df.withColumn("_k", key).where("_k is not null")
    got = rows.groupBy("_k").agg(F.min(F.struct(*order, *[c for c in first if c not in order])).alias("_f"), F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("n_records"))
    return got.select(F.col("_k").alias("merge_key"), *[F.col(f"_f.{c}").alias(c) for c in first], F.array_join("sources", ";").alias("sources"), "n_records")
