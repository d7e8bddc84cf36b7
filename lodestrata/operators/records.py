"""Operators on single records and on the ways they are shown, matched and patched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators.nearby import nearest_of, points_in_regions


def first_known(first: Column, second: Column) -> tuple[Column, Column, Column]:
    """(value, from, agrees) of two sources of one fact: the first where it says
    anything, else the second; whether both say the same, or null if one is silent."""
    return F.coalesce(first, second), F.when(first.isNotNull(), "first").when(second.isNotNull(), "second"), F.when(first.isNotNull() & second.isNotNull(), first == second)


def region_or_nearest(points: DataFrame, edges: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, region, exact): the smallest region that contains each point, else, not
    exact, that of the nearest centre (id, lat, lon); without centres null."""
    inside = points_in_regions(points, edges).groupBy("id").agg(F.min("region").alias("_r"))
    open_ = points.join(inside, "id", "left_anti")
    near = nearest_of(open_, centres).select(F.col("query_id").alias("id"), F.col("candidate_id").alias("_n"))
    return points.select("id").join(inside, "id", "left").join(near, "id", "left").select("id", F.coalesce("_r", "_n").alias("region"), F.col("_r").isNotNull().alias("exact"))


def appended(df: DataFrame, additions: DataFrame, key: str, array: str, item: str, order: str) -> DataFrame:
    """Rows with the approved items of another table put at the end of an array, in
    order; an item that the array holds already is not put in again."""
    more = additions.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct(order, item))), lambda x: x[item]).alias("_more"))
    old = F.coalesce(array, F.array().cast(df.schema[array].dataType))
    new = F.filter(F.coalesce("_more", F.array().cast(df.schema[array].dataType)), lambda x: ~F.array_contains(old, x))
    return df.join(more, key, "left").withColumn(array, F.concat(old, F.array_distinct(new))).drop("_more")


def updated(df: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """All rows, with changed columns where a condition holds; where it is null nothing changes."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def strongest(df: DataFrame, key: str, label: str, amount: str) -> DataFrame:
    """(key, bonus, friction): the label with the greatest amount above zero and the one
    with the least below; of equals the first in order."""
    best = F.min(F.when(F.col(amount) > 0, F.struct(-F.col(amount), label)))
    worst = F.min(F.when(F.col(amount) < 0, F.struct(amount, label)))
    return df.groupBy(key).agg(best.alias("_b"), worst.alias("_w")).select(key, F.col(f"_b.{label}").alias("bonus"), F.col(f"_w.{label}").alias("friction"))


def shown(df: DataFrame, sort: str, key: str, search: str | None = None, fields: Sequence[str] = (), keep: Column | None = None, descending: bool = True) -> DataFrame:
    """Rows that a reader's filter and search leave, with nulls last in either
    direction; the search doesn't mind accents and case."""
    out = df if keep is None else df.where(keep)
    if search:
        wanted = text.accent_fold(F.lit(search))
        out = out.where(F.greatest(F.lit(False), *[F.coalesce(F.contains(text.accent_fold(F.col(c)), wanted), F.lit(False)) for c in fields]))
    return out.orderBy(F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort), key)


def ranked_shares(df: DataFrame, label: str, share: str, invert: Sequence[str] = ()) -> DataFrame:
    """Labels by share, the greatest first, some of them counted the other way round
    (100 - share); nulls are not ranked. One row per label."""
    s = F.when(F.col(label).isin(*invert), 100 - F.col(share)).otherwise(F.col(share)) if invert else F.col(share)
    out = df.withColumn(share, F.round(s, 4)).where(F.col(share).isNotNull())
    return out.withColumn("position", F.row_number().over(W.orderBy(F.desc(share), label)))


def grouped(df: DataFrame, group: str, item: str, order: Sequence[str]) -> DataFrame:
    """(group, items): the items of each group in order; groups without any have no row."""
    rows = df.where(F.col(item).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(F.struct(*order, item))).alias("_i"))
    return rows.select(group, F.array_join(F.transform("_i", lambda x: x[item]), ",").alias("items"))


def state_changes(last: DataFrame, now: DataFrame, key: str, ranks: Sequence[tuple[str, str]], first: str) -> DataFrame:
    """(key, event) of the keys whose state moved: ``first`` for those not known before,
    else the event of the first column in ``ranks`` (column, event) that differs."""
    cols = [c for c, _ in ranks]
    old = last.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_known"))
    both = now.select(key, *cols).join(old, key, "left")
    event = F.when(F.col("_known").isNull(), first)
    for c, name in ranks:
        event = event.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), name)
    return both.withColumn("event", event).where("event is not null").select(key, "event")


def first_mention(texts: DataFrame, key: str, body: str, places: DataFrame, place: str, keyword: str) -> DataFrame:
    """(key, place): the place whose whole name, in comparison form, stands first in a
    text that also holds a keyword (pattern). Names are found word by word: an equi-join
    on a name's first word, then the words after it are compared."""
    t = texts.where(F.col(body).rlike(keyword)).select(key, F.filter(F.split(F.regexp_replace(text.accent_fold(F.col(body)), "[^a-z0-9]+", " "), " "), lambda w: w != "").alias("_w"))
    p = places.select(F.col(place).alias("_place"), text.tokens(F.col(place)).alias("_n")).where(F.size("_n") > 0).distinct().withColumn("_f", F.get("_n", F.lit(0)))
    at = t.select(key, "_w", F.posexplode("_w").alias("_at", "_f"))
    hit = at.join(p, "_f").where(F.slice("_w", F.col("_at") + 1, F.size("_n")) == F.col("_n"))
    return hit.groupBy(key).agg(F.min(F.struct("_at", (-F.size("_n")).alias("_s"), "_place")).alias("_m")).select(key, F.col("_m._place").alias("place"))


def merged_in_order(df: DataFrame, key: Column, order: Sequence[str], source: str, first: Sequence[str], groups: str | None = None) -> DataFrame:
    """Records of several feeds put together by key, in order: the first record's
    fields, all sources without repeats in the order met, the others as ``also_in``,
    and the first ``groups`` that isn't null."""
    rows = df.withColumn("_k", key).where("_k is not null")
    every = F.array_sort(F.collect_list(F.struct(*order, F.col(source).alias("_s"))))
    met = F.array_distinct(F.array_compact(F.transform(every, lambda x: x["_s"])))
    more = [F.min(F.when(F.col(groups).isNotNull(), F.struct(*order, groups))).alias("_g")] if groups else []
    got = rows.groupBy("_k").agg(F.min(F.struct(*order, *[c for c in first if c not in order])).alias("_f"), met.alias("_m"), *more)
    cols = [F.col("_k").alias("merge_key"), *[F.col(f"_f.{c}").alias(c) for c in first], F.array_join("_m", ";").alias("sources"), F.array_join(F.slice("_m", 2, F.greatest(F.lit(1), F.size("_m"))), ";").alias("also_in")]
    return got.select(*cols, *([F.col(f"_g.{groups}").alias(groups)] if groups else []))


def keyed_hash(message: Column, secret: bytes) -> Column:
    """HMAC with SHA-256, as hexadecimal digits; null stays null."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)
