"""Streaming twins of the operators that keep state.

``first_seen`` keeps the first row of each key within a watermark, and
``change_log`` writes a row for every change of a key's state; replays of a batch
add nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.runtime import drop_path, names_in


def first_seen(stream: DataFrame, key: list[str], time: str, late: str = "8 days") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def changes(batch: DataFrame, last: DataFrame | None, key: str, order: list[str], state: list[str]) -> DataFrame:
    """(key, order, state, from_*) of the rows that change a key's state; ``last`` has
    one row per key with the state before the batch."""
    w = W.partitionBy(key).orderBy(*order)
    rows = batch.select(key, *order, *state)
    before = None if last is None else last.select(key, *[F.col(s).alias(f"_l_{s}") for s in state], F.lit(True).alias("_known"))
    out = rows if before is None else rows.join(before, key, "left")
    out = out.withColumn("_n", F.row_number().over(w))
    for s in state:
        old = F.col(f"_l_{s}") if before is not None else F.lit(None)
        out = out.withColumn(f"from_{s}", F.when(F.col("_n") == 1, old).otherwise(F.lag(s).over(w)))
    known = F.col("_known").isNotNull() if before is not None else F.lit(False)
    same = F.lit(True)
    for s in state:
        same = same & F.col(s).eqNullSafe(F.col(f"from_{s}"))
    return out.where(~((F.col("_n") > 1) | known) | ~same).select(key, *order, *state, *[f"from_{s}" for s in state])


def change_log(stream: DataFrame, path: str, checkpoint: str, key: str, order: list[str], state: list[str]) -> StreamingQuery:
    """Appends changes to a table under ``path/log``, one folder per batch, which a
    replay of the batch replaces. The last state of each key stands in
    ``path/state``, one folder per batch, of which the two newest are kept; a
    batch reads the state before it and never the log."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = sorted(int(n.split("=")[1]) for n in names_in(spark, f"{path}/state") if n.startswith("batch="))
        before = [n for n in known if n < number]
        cols = [key, *order, *state]
        last = spark.read.parquet(f"{path}/state/batch={before[-1]}") if before else None
        changes(batch, last, key, order, state).write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        rows = batch.select(*cols) if last is None else last.select(*cols).unionByName(batch.select(*cols))
        rows.groupBy(key).agg(F.max_by(F.struct(*order, *state), F.struct(*order)).alias("_s")).select(key, "_s.*").write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        for old in before[:-1]:
            drop_path(spark, f"{path}/state/batch={old}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
