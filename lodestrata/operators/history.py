"""History of changing attributes, from periodic snapshots.

Insert-only satellites: attributes are split by how fast they change, each group
has its own satellite, and a row is appended only when the hash of the group's
values differs from that of the recorded day before. Nothing is ever updated:
end days are computed on reading, as the next start.

``observations`` first reduces the snapshots to one row per key and day, by an
aggregation that combines before the shuffle; repeated rows, hot keys and late
rows cost no more than that. What is then ordered per key is bounded by the
number of calendar days.

Edge cases: rows with a null key, no readable day or a null in a required
attribute say nothing; of several rows of one key and day the one recorded last
holds, then the greatest values; a null in another attribute is a value of its
own; empty tables give empty histories; columns not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def day_of(text: Column) -> Column:
    """The day of a date written with dashes, slashes, dots or nothing between
    year, month and day, with or without a time after it; else null."""
    part = lambda k: F.regexp_extract(text, r"^\s*(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})(?:\D.*)?$", k)
    return F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")


def version_text(text: Column) -> Column:
    """A version number without blanks, case and a leading v."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"[\s ]+", " "))), r"^v\.?\s*", ""), F.lit(""))


def grade_text(text: Column) -> Column:
    """A grade without blanks around it, in upper case."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(text, r"[\s ]+", " "))), F.lit(""))


def observations(snapshots: DataFrame, key: Column, day: Column, recorded: Column, attributes: dict[str, Column], required: list[str]) -> DataFrame:
    """(key, day, attributes): what is known of each key on each recorded day."""
    rows = snapshots.select(key.alias("key"), day.alias("day"), recorded.alias("_at"), *[c.alias(n) for n, c in attributes.items()])
    rows = rows.where(F.col("key").isNotNull() & F.col("day").isNotNull())
    for name in required:
        rows = rows.where(F.col(name).isNotNull())
    last = rows.groupBy("key", "day").agg(F.max(F.struct("_at", *attributes)).alias("_r"))
    return last.select("key", "day", *[F.col(f"_r.{n}").alias(n) for n in attributes])


def hash_diff(names: list[str]) -> Column:
    """A hash of the values that keeps nulls apart from empty texts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("-")) for n in names]), 256)


def satellite(obs: DataFrame, names: list[str]) -> DataFrame:
    """(key, day, hash_diff, attributes): the rows at which the hash changes."""
    w = W.partitionBy("key").orderBy("day")
    h = obs.select("key", "day", *names).withColumn("hash_diff", hash_diff(names)).withColumn("_before", F.lag("hash_diff").over(w))
    return h.where("_before is null or _before <> hash_diff").select("key", "day", "hash_diff", *names)


def satellites(obs: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """All satellites in one pass: (satellite, key, day, hash_diff, payload map).

    The hashes of every group are compared over one ordering of the
    observations, so two satellites cost no second shuffle.
    """
    w = W.partitionBy("key").orderBy("day")
    df = obs
    for g, names in groups.items():
        df = df.withColumn(f"_h_{g}", hash_diff(names))
    for g in groups:
        df = df.withColumn(f"_p_{g}", F.lag(f"_h_{g}").over(w))
    new = [
        F.when(
            F.col(f"_p_{g}").isNull() | (F.col(f"_p_{g}") != F.col(f"_h_{g}")),
            F.struct(F.lit(g).alias("satellite"), F.col(f"_h_{g}").alias("hash_diff"), F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names])).alias("payload")),
        )
        for g, names in groups.items()
    ]
    return df.select("key", "day", F.explode(F.array_compact(F.array(*new))).alias("_s")).select("_s.satellite", "key", "day", "_s.hash_diff", "_s.payload")


def split_by_rate(obs: DataFrame, names: list[str], factor: float = 2.0) -> dict[str, list[str]]:
    """Groups of attributes that change about as often, from the least: an attribute
    that changes more than ``factor`` times as often as the first of a group begins
    another. The rates are counted over all observations; only they reach the driver."""
    w = W.partitionBy("key").orderBy("day")
    before = obs.select("key", "day", *names, F.lit(True).alias("_is")).withColumns({f"_l_{n}": F.lag(n).over(w) for n in names} | {"_is": F.lag("_is").over(w)})
    rate = before.where("_is").agg(*[F.count_if(~F.col(n).eqNullSafe(F.col(f"_l_{n}"))).alias(n) for n in names]).first()
    groups: list[list[str]] = []
    for n in sorted(names, key=lambda n: (rate[n], n)):
        if groups and rate[n] <= factor * rate[groups[-1][0]]:
            groups[-1].append(n)
        else:
            groups.append([n])
    return {"+".join(g): g for g in groups}


def versions(sats: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to) of every version of the keys: a view over the
    satellites, in which a row of any satellite starts a version and ends the one
    before. valid_to is null for the version that still holds."""
    starts = sats.groupBy("key", "day").agg(F.count("*").alias("_n"))
    return starts.select("key", F.col("day").alias("valid_from"), F.lead("day").over(W.partitionBy("key").orderBy("day")).alias("valid_to"))


def append(obs_before: DataFrame, batch_obs: DataFrame, groups: dict[str, list[str]], sats_before: DataFrame) -> DataFrame:
    """The satellite rows that a batch of observations adds, to be appended.

    Only the keys of the batch are looked at. A row that comes late may also
    bring back a row that was left out as unchanged, so the rows of those keys
    are compared again over their observations, and what the satellites already
    hold is taken away. A row that a late one makes superfluous stays: the view
    ``effective`` passes over it.
    """
    keys = batch_obs.select("key").distinct()
    every = obs_before.join(keys, "key", "left_semi").join(batch_obs.select("key", "day"), ["key", "day"], "left_anti").unionByName(batch_obs)
    return satellites(every, groups).join(sats_before.select("satellite", "key", "day", "hash_diff"), ["satellite", "key", "day", "hash_diff"], "left_anti")


def effective(sats: DataFrame) -> DataFrame:
    """Satellite rows without those that repeat the row before them."""
    w = W.partitionBy("satellite", "key").orderBy("day")
    return sats.withColumn("_b", F.lag("hash_diff").over(w)).where("_b is null or _b <> hash_diff").drop("_b")


def as_text(df: DataFrame, key_name: str) -> DataFrame:
    """Versions with days as text and an open end at 9999-12-31."""
    return df.select(F.col("key").alias(key_name), F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit(OPEN_END)).alias("valid_to"))
