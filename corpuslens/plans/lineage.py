"""Cutting lineage through files that every executor can read, and shipping this package to them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: `spark.checkpoint.dir` of the session; a folder of our own only on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    """The written tables are of no use after the application; whoever ends without this leaves them to the folder's owner."""
    for spark, path in _WRITTEN:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001
            return  # the session has ended before


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's process ends with its session still there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


#: Whether a query's shuffle files are deleted at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from a written table, so that a lost executor costs no recomputation.

    The shuffle files that it took are deleted with the end of the write, as nothing reads them any more. The table is
    deleted when the driver's process ends with its session still there.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._cut_path = path
    return written


def discard(df: DataFrame) -> None:
    """Deletes the table of a `cut` that nothing reads any more."""
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.remove((df.sparkSession, df._cut_path))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
