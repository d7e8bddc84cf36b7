"""Rankings, quotas and walls.

Top-k goes by ``orderBy().limit()``, which Spark runs as a top-k per partition;
windows are used where every row needs its rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.stats import medians
from lodestrata.runtime import cut


def round_robin(df: DataFrame, outer: str, inner: str, key: str, most: int) -> DataFrame:
    """Rows dealt out in turns: in a group of ``outer`` the values of ``inner``
    alternate, and the groups alternate too; the first ``most`` of them."""
    # no more than ``most`` of each can be dealt out, which Spark limits before the shuffle
    rc = df.withColumn("_rc", F.row_number().over(W.partitionBy(outer, inner).orderBy(key))).where(F.col("_rc") <= most)
    rg = rc.withColumn("_rg", F.row_number().over(W.partitionBy(outer).orderBy("_rc", inner)))
    return rg.orderBy("_rg", outer).limit(most).withColumn("turn", F.col("_rg")).drop("_rc", "_rg")


def closest_to_median(df: DataFrame, value: str, key: str, most: int, digits: int = 1) -> DataFrame:
    mid = medians(df, value).select(F.round("median", digits).alias("mid"))
    return df.crossJoin(F.broadcast(mid)).withColumn("gap", F.abs(F.col(value) - F.col("mid"))).orderBy("gap", key).limit(most)


def middle_row(df: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """The row in the middle by key: at position n // 2, counted from 0. A group is
    put in order in one task, so it has to be one that a reader could look through."""
    w = W.partitionBy(*group)
    return df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(key))).where("_r = floor(_n / 2) + 1").drop("_r", "_n")


def relaxed(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """Rows that fulfil the longest prefix of conditions that any row fulfils."""
    length = F.lit(0)
    for k in range(len(conditions), 0, -1):
        cond = conditions[0]
        for c in conditions[1:k]:
            cond = cond & c
        length = F.when(cond & (length == 0), F.lit(k)).otherwise(length) if k < len(conditions) else F.when(cond, F.lit(k)).otherwise(F.lit(0))
    met = df.withColumn("n_met", F.coalesce(length, F.lit(0)))
    best = met.agg(F.max("n_met").alias("_m"))
    return met.join(F.broadcast(best), met["n_met"] == best["_m"]).drop("_m")


def percentile_labels(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Share of a group's rows at or below and at or above each value, in percent,
    rounded up. Equal values are counted before they are put in order."""
    n = df.groupBy(*group, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*group)
    upto = n.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_c").over(w))
    pct = lambda c: F.least(F.lit(99), F.greatest(F.lit(1), F.ceil(F.round(c * 100, 6)))).cast("int")
    share = upto.select(*group, value, pct(F.col("_upto") / F.col("_all")).alias("pct_at_or_below"), pct((F.col("_all") - F.col("_upto") + F.col("_c")) / F.col("_all")).alias("pct_at_or_above"))
    return df.join(share, [*group, value], "left")


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Every row's place in one order over all rows, without one task that sees them
    all: ranges are numbered alone and shifted by the sizes of those before them."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row per range
    shift = sizes.withColumn("_s", F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))).select("_p", F.coalesce("_s", F.lit(0)).alias("_s"))
    own = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    return own.join(F.broadcast(shift), "_p").withColumn(name, F.col("_r") + F.col("_s")).drop("_p", "_r", "_s")


def related(df: DataFrame, key: str, relations: Sequence[tuple[str, int]], order: str, most: int) -> DataFrame:
    """Up to ``most`` related rows of each row: for each relation, in order of
    priority, up to its quota of rows with the same value, by ``order``.

    A group's members are reduced to its first quota + 1 in order before they are
    joined, so a hot group is never paired with itself.
    """
    picked = None
    for p, (col, quota) in enumerate(relations):
        need = sum(q for _, q in relations[: p + 1])
        head = df.where(F.col(col).isNotNull()).select(col, F.col(key).alias("related"), F.col(order).alias("_o")).withColumn("_r", F.row_number().over(W.partitionBy(col).orderBy("_o", "related"))).where(F.col("_r") <= need + 1)
        part = df.select(key, col).join(head, col).where(F.col(key) != F.col("related")).select(key, "related", "_o", F.lit(p).alias("relation"))
        if picked is not None:
            part = part.join(picked.select(key, "related"), [key, "related"], "left_anti")
        part = part.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("_o", "related"))).where(F.col("_k") <= quota).drop("_k")
        picked = part if picked is None else picked.unionByName(part)
    return picked.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("relation", "_o", "related"))).where(F.col("position") <= most).select(key, "related", "position", "relation")


def change_events(df: DataFrame, key: str, order: Sequence[str], state: Sequence[str]) -> DataFrame:
    """Rows whose state differs from the row before them of the same key; ``changed``
    names the first state column that differs, or is new."""
    w = W.partitionBy(key).orderBy(*order)
    cur = df.withColumn("_first", F.row_number().over(w) == 1)
    for s in state:
        cur = cur.withColumn(f"from_{s}", F.lag(s).over(w))
    kind = F.when(F.col("_first"), "new")
    for s in state:
        kind = kind.when(~F.col(s).eqNullSafe(F.col(f"from_{s}")), s)
    return cur.withColumn("changed", kind).where("changed is not null").drop("_first")
