"""Two-level weighted scores, coverage, confidence and grades of sites.

Input is the long fact table: one row per site and indicator with its pillar,
block, weights, status and two scores, ``norm`` (null where nothing is known) and
``sub`` (zero where something was looked for and not found). Every operator is a
sequence of hash aggregations that combine before the shuffle.

Weights of zero, or no rows at all, give null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import rules


def scored(facts: DataFrame, norm: Column) -> DataFrame:
    """Facts with both score columns; ``status`` and ``block`` must be there."""
    n = facts.withColumn("norm", rules.capped(norm, F.col("status")))
    return n.withColumn("sub", rules.substantive(F.col("norm"), F.col("status"), F.col("block")))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over the rows that have a value."""
    return F.try_divide(F.sum(F.when(value.isNotNull(), weight * value)), F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0)))


def two_level_mean(facts: DataFrame, by: list[str], value: str = "sub", where: Column | None = None) -> DataFrame:
    """(by, score): mean within pillars, then of the pillars, each level over what
    it has."""
    rows = facts if where is None else facts.where(where)
    pillars = rows.groupBy(*by, "pillar", "pillar_weight").agg(weighted_mean(F.col(value), F.col("weight")).alias("_p"))
    return pillars.groupBy(*by).agg(weighted_mean(F.col("_p"), F.col("pillar_weight")).alias("score"))


def coverage(facts: DataFrame, by: list[str], pillar_weighted: bool = True) -> DataFrame:
    """(by, coverage): share of the weight that has a value before zeros are filled in."""
    w = F.col("weight") * F.col("pillar_weight") if pillar_weighted else F.col("weight")
    return facts.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("norm").isNotNull(), w).otherwise(0.0)), F.nullif(F.sum(w), F.lit(0.0))).alias("coverage"))


def confidence(facts: DataFrame, by: list[str]) -> DataFrame:
    """Confidence and the shares that lower it: gaps, declared and estimated."""
    w = F.col("weight") * F.col("pillar_weight") * F.col("tier_weight")
    share = lambda cond: F.try_divide(F.sum(F.when(cond, w).otherwise(0.0)), F.nullif(F.sum(w), F.lit(0.0)))
    s = F.col("status")
    got = facts.groupBy(*by).agg(share(s.isin("missing", "not_collected")).alias("gap"), share(s == "announced").alias("declared"), share(s == "estimated").alias("estimated"))
    raw = F.greatest(F.lit(0.0), 1 - F.col("gap") - rules.DECLARED_PENALTY * (F.col("declared") + F.col("estimated")))
    return got.withColumn("raw", raw).withColumn("level", rules.confidence_level(raw))


def gated(coverage: Column, floor: float = rules.MIN_COVERAGE) -> Column:
    return F.when(coverage.isNull() | (coverage < floor), F.lit("insufficient_data"))


def scorecard(facts: DataFrame, by: list[str]) -> DataFrame:
    """Score, letter and coverage per site, in one pass over the facts."""
    w = F.col("weight") * F.col("pillar_weight")
    p = facts.groupBy(*by, "pillar", "pillar_weight").agg(
        weighted_mean(F.col("sub"), F.col("weight")).alias("_p"),
        F.sum(F.when(F.col("norm").isNotNull(), w).otherwise(0.0)).alias("_have"),
        F.sum(w).alias("_all"),
    )
    s = p.groupBy(*by).agg(weighted_mean(F.col("_p"), F.col("pillar_weight")).alias("score"), F.try_divide(F.sum("_have"), F.nullif(F.sum("_all"), F.lit(0.0))).alias("coverage"))
    return s.withColumn("grade", F.coalesce(gated(F.col("coverage")), rules.letter(F.col("score"))))


def worst_pillar(pillars: DataFrame, by: list[str], pillar: str, score: str) -> DataFrame:
    """The pillar with the worst letter, then the lowest score, then the first name."""
    severity = F.lit(255) - F.ascii(rules.letter(F.col(score)))
    ordered = pillars.where(F.col(score).isNotNull()).groupBy(*by).agg(F.min(F.struct(severity, F.col(score), F.col(pillar))).alias("_m"))
    return ordered.select(*by, F.col(f"_m.{pillar}").alias("worst_pillar"), rules.letter(F.col(f"_m.{score}")).alias("worst_grade"), F.col(f"_m.{score}").alias("worst_score"))

