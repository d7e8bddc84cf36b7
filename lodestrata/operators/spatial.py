"""Nearest neighbours, rings, boxes and dedupes by distance, on top of ``nearby``.

Inputs are (id, lat, lon). Nothing is paired that isn't near: nearest neighbours
are searched in the parts of space that a first bound allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.nearby import nearest_of, points_within


def nearest(points: DataFrame, others: DataFrame) -> DataFrame:
    """(query_id, candidate_id, metres): the nearest of the others, the smaller id
    where two are equally near. Points without any other at all give no row."""
    return nearest_of(points, others)


def rings(points: DataFrame, others: DataFrame, edges_m: Sequence[float]) -> DataFrame:
    """(id, ring): index of the first ring with a hit, or null if none is so near."""
    near = points_within(points, others, edges_m[-1]).groupBy("query_id").agg(F.min("metres").alias("metres"))
    ring: Column = F.lit(None).cast("int")
    for k in range(len(edges_m) - 1, -1, -1):
        ring = F.when(F.col("metres") <= edges_m[k], F.lit(k)).otherwise(ring)
    return points.select("id").join(near.withColumnRenamed("query_id", "id"), "id", "left").select("id", ring.alias("ring"))


def distance_dedupe(new: DataFrame, known: DataFrame, radius_m: float) -> DataFrame:
    """(id, twin): each new point with the first known id near it, or null."""
    twin = points_within(new, known, radius_m).groupBy("query_id").agg(F.min("candidate_id").alias("twin"))
    return new.select("id").join(twin.withColumnRenamed("query_id", "id"), "id", "left")


def outside_boxes(points: DataFrame, others: DataFrame, half_deg: float) -> DataFrame:
    """Points with no other closer than ``half_deg`` in both latitude and longitude.

    An equi-join on cells of half that size. A point whose own cell holds another
    is decided by the cell alone. For those of the cells around, the others are
    reduced to one row per cell and fine step of longitude: the extremes in latitude.
    """
    size = half_deg / 2
    cell = lambda c: F.floor(F.col(c) / size)
    o = others.select("lat", "lon").distinct().withColumn("_ca", cell("lat")).withColumn("_co", cell("lon"))
    full = o.select("_ca", "_co").distinct()
    p = points.withColumn("_ca", cell("lat")).withColumn("_co", cell("lon"))
    left = p.join(full, ["_ca", "_co"], "left_anti")
    steps = F.array(*[F.lit(d) for d in range(-2, 3)])
    asked = left.select("id", F.col("lat").alias("_a"), F.col("lon").alias("_o"), F.col("_ca").alias("_x"), F.col("_co").alias("_y"), F.explode(steps).alias("_i"))
    asked = asked.select("id", "_a", "_o", (F.col("_x") + F.col("_i")).alias("_ca"), "_y", F.explode(steps).alias("_j")).withColumn("_co", F.col("_y") + F.col("_j")).drop("_y", "_j")
    # only cells that are asked for keep their points, and of each longitude the extremes that could be near
    kept = o.join(asked.select("_ca", "_co").distinct(), ["_ca", "_co"], "left_semi").groupBy("_ca", "_co", "lon").agg(F.min("lat").alias("_lo"), F.max("lat").alias("_hi"))
    near = lambda c: F.abs(F.col(c) - F.col("_a")) < half_deg
    close = asked.join(kept, ["_ca", "_co"]).where((F.abs(F.col("lon") - F.col("_o")) < half_deg) & (near("_lo") | near("_hi"))).select("id").distinct()
    return left.drop("_ca", "_co").join(close, "id", "left_anti")


def counts_within(points: DataFrame, others: DataFrame, radii_m: Sequence[float]) -> DataFrame:
    """(id, n_0, n_1, ...): how many others lie within each radius."""
    near = points_within(points, others, max(radii_m))
    got = near.groupBy("query_id").agg(*[F.count_if(F.col("metres") <= r).alias(f"n_{k}") for k, r in enumerate(radii_m)])
    out = points.select("id").join(got.withColumnRenamed("query_id", "id"), "id", "left")
    return out.select("id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in range(len(radii_m))])
