"""Shared plumbing: table reading, shared-folder tables that cut lineage, hot-key salts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LARGE = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="mosaicveil-")
    return made


def keep(df: DataFrame, name: str, batch: int | None = None, large: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: short lineage, and a lost executor loses nothing.

    batch: most rows that meanwhile go to Python at once; what an executor's JVM holds for them is beyond its heap. large: rows are of
    MBs, so each gets pages of its own and row groups stay small; else Parquet gathers 100 rows before it looks at their size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_BATCH, None)
    if batch:
        spark.conf.set(_BATCH, str(batch))
    try:
        df.write.options(**(_LARGE if large else {})).parquet(path)
    finally:
        if batch and was is None:
            spark.conf.unset(_BATCH)
        elif batch:
            spark.conf.set(_BATCH, was)
    atexit.register(_drop, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def forget(*kept: DataFrame | None) -> None:
    """Remove tables of keep() that nothing reads any more."""
    for df in kept:
        path = getattr(df, "kept_at", None)
        if path:
            _drop(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs that nothing refers to; else they stay until the driver's JVM happens
    to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(column: str = "doc_id"):
    """crc32 of the id written as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
