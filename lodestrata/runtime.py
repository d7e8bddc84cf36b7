"""Session helpers: table access and cutting of lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, tempfile.TemporaryDirectory] = {}


def local_session(app: str = "lodestrata", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and everything runs in one process, as in
    tests, a temporary folder is made; it lives as long as the process. Elsewhere
    executors would write to disks that others can't read, so that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not in_one_process(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.TemporaryDirectory(prefix="lodestrata-")
    return "file://" + _OWN_DIR[app].name


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _MADE.append((spark, path))
    return path


_MADE: list[tuple[SparkSession, str]] = []


@atexit.register
def clear_shared() -> None:
    """Delete what this process put into the shared folder."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone, and with it the way to the folder
            return


def cut(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Lineage ends here, so a lost executor costs a read of files and no
    recomputation; by-columns, if given, cluster the rows of the files. What isn't
    given to ``free`` before is deleted when the process ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    out = df.repartition(*by) if by else df
    out.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.cut_path = path
    return got


def free(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``cut`` made and nobody reads any more."""
    for t in tables:
        path = getattr(t, "cut_path", None)
        if path:
            drop_path(t.sparkSession, path)
            _MADE[:] = [m for m in _MADE if m[1] != path]
            t.cut_path = None


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder of the shared store, in order; none if there is no such folder."""
    at, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file of this name, made at once."""
    at, fs = _folder(spark, path)
    fs.create(at, False).close()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever file system it is on."""
    at, fs = _folder(spark, path)
    fs.delete(at, True)


_KEPT: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once."""
    app = spark.sparkContext.applicationId
    if app in _KEPT:
        return
    root = Path(__file__).resolve().parent
    _KEPT[app] = tempfile.TemporaryDirectory(prefix="lodestrata-ship-")  # the driver serves the file from here
    path = Path(_KEPT[app].name, "lodestrata.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
