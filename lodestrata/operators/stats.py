"""Corpus statistics: shares with counted exclusions, perimeters, indices.

Shares can't be added up over regions, so every perimeter is computed from the
rows: a row is exploded into its perimeters before one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import rules
from lodestrata.runtime import cut

MIN_N = 5
# Statuses that count as assessed.
ASSESSED = ("measured", "announced", "verified")


def perimeters(df: DataFrame, levels: Sequence[str], everything: str = "all") -> DataFrame:
    """Each row once for every perimeter that it belongs to."""
    labels = F.array_compact(F.array(F.lit(everything), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in levels]))
    return df.withColumn("perimeter", F.explode(labels))


def wired_share(df: DataFrame, group: str, status: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of positive rows among the assessed ones, over the groups that have any
    assessed row at all; other rows of those groups are counted as excluded. Below
    ``MIN_N`` rows the share is withheld."""
    ok = F.col(status).isin(*ASSESSED)
    per = df.groupBy(*by, group).agg(F.count_if(ok).alias("_a"), F.count_if(ok & F.coalesce(positive, F.lit(False))).alias("_p"), F.count_if(F.col(status) == "missing").alias("_m"), F.count_if(F.coalesce(F.col(status) == "not_collected", F.lit(True))).alias("_nc"))
    w = per.where("_a > 0")
    out = w.groupBy(*by).agg(F.sum("_a").alias("n"), F.sum("_p").alias("n_positive"), F.sum("_m").alias("excluded_missing"), F.sum("_nc").alias("excluded_not_collected"), F.array_join(F.array_sort(F.collect_set(group)), ",").alias("wired"))
    return out.withColumn("share", F.when(F.col("n") >= MIN_N, F.round(F.col("n_positive") / F.col("n"), 4)))


def disclosure(df: DataFrame, value: str, by: Sequence[str], least: int = MIN_N) -> DataFrame:
    """Share of rows that disclose a value, where there are enough rows."""
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(value).alias("n_disclosed"), F.round(F.sum(value), 2).alias("total"))
    return got.withColumn("share", F.when(F.col("n") >= least, F.round(F.col("n_disclosed") / F.col("n"), 4)))


def modal(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value; of several, the one met first in order."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_o"))
    return n.groupBy(*by).agg(F.min(F.struct(-F.col("n"), "_o", value)).alias("_m")).select(*by, F.col(f"_m.{value}").alias("modal"))


def medians(df: DataFrame, value: str, group: Sequence[str] = (), name: str = "median") -> DataFrame:
    """(group, median) of the non-null values of each group, exact, without a task
    that holds a group: equal values are counted, ranges of (group, value) are summed
    up alone, and the places in the middle are found by the sums before them.

    Groups may be null; a group without values has no row. Ties count as often as
    they come; of an even number of values it is the mean of the two in the middle.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*group) if group else F.lit(0)
    n = df.where(F.col(value).isNotNull()).select(key.alias("_g"), F.col(value).cast("double").alias("_v")).groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    ranged = cut(n.repartitionByRange(parts, "_g", "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    # of each group as many rows as it has ranges
    sums = ranged.groupBy("_g", "_p").agg(F.sum("_c").alias("_s"))
    own = W.partitionBy("_g")
    before = sums.withColumn("_all", F.sum("_s").over(own)).withColumn("_before", F.sum("_s").over(own.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s"))
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    # only the ranges that hold a middle are put in order
    middle = before.where((F.col("_before") <= hi) & (F.col("_before") + F.col("_s") > lo)).select(F.col("_g").alias("_g2"), F.col("_p").alias("_p2"), "_all", "_before")
    rows = ranged.join(middle, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_p") == F.col("_p2")))
    upto = rows.withColumn("_end", F.col("_before") + F.sum("_c").over(W.partitionBy("_g", "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    at = lambda k: (F.col("_end") > k) & (F.col("_end") - F.col("_c") <= k)
    got = upto.where(at(lo) | at(hi)).groupBy("_g").agg(F.avg("_v").alias(name))
    return got.select(*([f"_g.{g}" for g in group] if group else []), name)


def index(df: DataFrame, group: str, score: str, weight: str, documentation: str, verified: Column, least: int = MIN_N) -> DataFrame:
    """Index of a group: mean, letter with reserve, median documentation, and the
    mean by weight where enough rows have one. Small groups get their count alone."""
    has = F.col(score).isNotNull()
    heavy = has & (F.col(weight) > 0)
    g = df.groupBy(group).agg(
        F.count(score).alias("n"), F.round(F.avg(score), 1).alias("_mean"), F.bool_or(verified).alias("_v"),
        F.count_if(heavy).alias("_nw"), F.round(F.try_divide(F.sum(F.when(heavy, F.col(score) * F.col(weight))), F.sum(F.when(heavy, F.col(weight)))), 1).alias("_wm"),
    )
    mid = medians(df, documentation, [group], "_mid").withColumnRenamed(group, "_group")
    g = g.join(mid, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_doc", F.round("_mid", 3))
    ok = F.col("n") >= least
    return g.select(
        group, "n", ok.alias("eligible"), F.when(ok, F.col("_mean")).alias("mean"), F.when(ok, rules.reserved(rules.letter(F.col("_mean"), None), F.coalesce("_v", F.lit(False)))).alias("grade"),
        F.when(ok, rules.ladder([(F.col("_doc") >= 0.75, "solid"), (F.col("_doc") >= 0.5, "middling")], "weak")).alias("documentation"), F.when(ok & (F.col("_nw") >= least), F.col("_wm")).alias("weighted_mean"),
    )


def violations(parts: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(gate, entity, message): the rows that break a rule, all gates in one table.
    Each part is (gate, offending rows with a column ``entity``, message)."""
    out = None
    for gate, df, message in parts:
        p = df.select(F.lit(gate).alias("gate"), F.col("entity").cast("string").alias("entity"), F.lit(message).alias("message"))
        out = p if out is None else out.unionByName(p)
    return out
