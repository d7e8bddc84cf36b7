"""Snapshots of what a service gave, kept in a folder that all executors share.

A snapshot is a folder of its own; a mark beside it makes it valid, so a broken write
is never read. If a service fails, the last snapshot stands in, whatever its age.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.runtime import drop_path, mark, names_in


class NoSnapshot(RuntimeError):
    """The service failed and nothing had been kept."""


def snapshot(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], max_age_s: float, keep: int = 2, now: Callable[[], float] = time.time) -> tuple[DataFrame, bool]:
    """(rows, fresh): the newest snapshot if it is no older than ``max_age_s``, else a new
    one; the old one, not fresh, if ``fetch`` fails. The ``keep`` newest are kept."""
    marks = [int(n.removeprefix("valid-")) for n in names_in(spark, path) if n.startswith("valid-")]
    read = lambda k: spark.read.parquet(f"{path}/data-{k:016d}")
    stamp = int(now() * 1000)
    if marks and stamp - marks[-1] <= max_age_s * 1000:
        return read(marks[-1]), True
    try:
        fetch().write.mode("overwrite").parquet(f"{path}/data-{stamp:016d}")
    except Exception as e:  # whatever a service may raise
        if not marks:
            raise NoSnapshot(path) from e
        return read(marks[-1]), False
    mark(spark, f"{path}/valid-{stamp:016d}")
    for old in [*marks, stamp][:-keep]:
        drop_path(spark, f"{path}/valid-{old:016d}")
        drop_path(spark, f"{path}/data-{old:016d}")
    return read(stamp), True
