"""Shared pieces of the text operators: reading tables, staging intermediate
tables in the shared folder, and the byte tests that several of them use."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own where it is unset and the master is local (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="larkdoc-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def staged(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage; the copy outlives any executor. Removed by discard(), or when the process ends.
    The shuffle files of the write go as soon as it is over."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/larkdoc/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _STAGED.append((spark, path))
    got = spark.read.schema(df.schema).parquet(path)
    got._staged_at = path
    return got


def discard(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            _delete(df.sparkSession, path)
            _STAGED[:] = [x for x in _STAGED if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of queries that are over; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where df has columns of these names."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


@atexit.register
def _sweep() -> None:
    for spark, path in _STAGED:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            continue


def crc_mod(col, m: int):
    """crc32 of the id as text, modulo m; the split of labelled rows. Null ids count as the empty string."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what a Python worker holds at once: texts may be long, so batches have few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
