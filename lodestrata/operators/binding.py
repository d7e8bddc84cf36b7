"""Binding of records by words that they share.

Records of one place are bound if their names share a word that tells something;
the decision depends on how many different values the bound records propose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import tokens

# Words that tell nothing.
GENERIC = ("centre", "donnees", "center", "centro", "datos", "campus", "server", "datacenter", "rechenzentrum", "digitale", "numerique", "projekt", "project", "projet", "proyecto", "building", "batiment", "phase", "north", "south")


def telling(name: Column, generic: Sequence[str], least: int = 5) -> Column:
    return F.filter(tokens(name, least), lambda w: ~w.isin(*generic))


def hits(left: DataFrame, right: DataFrame, key: str, place: str, name: str, value: str, generic: Sequence[str]) -> DataFrame:
    """(key, value) of records in the same place that share a telling word: an
    equi-join on place and word, so a big place isn't paired with itself."""
    l = left.where(F.col(place).isNotNull()).select(key, place, F.explode(F.array_distinct(telling(F.col(name), generic))).alias("_w"))
    r = right.where(F.col(place).isNotNull()).select(place, F.explode(F.array_distinct(telling(F.col(name), ()) if not generic else telling(F.col(name), generic))).alias("_w"), value).distinct()
    return l.join(r, [place, "_w"]).select(key, value).distinct()


def decision(n: Column) -> Column:
    return F.when(n == 1, "propose").when(n > 1, "ambiguous").otherwise("absent")


def bind(left: DataFrame, right: DataFrame, key: str, place: str, name: str, value: str, generic: Sequence[str]) -> DataFrame:
    """(key, decision, value): one value proposes, several are ambiguous."""
    got = hits(left, right, key, place, name, value, generic).groupBy(key).agg(F.count(value).alias("_n"), F.max(value).alias("_v"))
    out = left.where(F.col(place).isNotNull()).select(key).join(got, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return out.select(key, decision(F.col("_n")).alias("decision"), F.when(F.col("_n") == 1, F.col("_v")).alias("value"))


def bind_or_operator(left: DataFrame, right: DataFrame, key: str, place: str, name: str, operator: str, value: str, generic: Sequence[str]) -> DataFrame:
    """As ``bind``; where nothing is bound, records of the same operator make the
    case ambiguous, or withheld if none of them has a value."""
    strict = hits(left, right, key, place, name, value, generic).groupBy(key).agg(F.count(value).alias("_n"))
    per = right.where(F.col(operator).isNotNull()).groupBy(operator).agg(F.count(value).alias("_o"))
    out = left.select(key, operator).join(strict, key, "left").join(per, operator, "left")
    n = F.coalesce("_n", F.lit(0))
    return out.select(key, F.when(n > 0, decision(n)).when(F.col("_o") > 0, "ambiguous").when(F.col("_o").isNotNull(), "withheld").otherwise("absent").alias("decision"))
