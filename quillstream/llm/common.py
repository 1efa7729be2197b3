"""Helpers shared by the training-data operators: stored intermediates, stable ids, text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; in local mode a temporary one if unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillstream_"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    A lost executor costs nothing that was stored; unlike a checkpoint the files are compressed and
    later readers prune columns. ``sweep`` (also run at exit) deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstream-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Narrow rows (ids, hashes, sketches) that one task takes, about.
TASK_ROWS = 50_000


def sized(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` of about so many rows in as many tasks as they need, or in those it has if these are fewer.

    Shuffle partitions are chosen for the whole input; a step over a small part of it need not start a task for each.
    Rows that lie in one partition stay in one.
    """
    return df.coalesce(max(1, -(-rows // task_rows)))


def sweep() -> None:
    """Delete the stored intermediates of this process; results that still read them become invalid."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is already gone at exit
            return


atexit.register(sweep)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables. Python workers started from now on also look for this package where it is here."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [environment.get("PYTHONPATH"), root]))
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if table == "documents" and df.rdd.getNumPartitions() < cores:  # a small table of few splits is dealt out to all cores
        df = df.repartition(cores)
    return df


def fold(column: str, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod


def text_key(column: str = "text") -> Column:
    """128-bit key of a text (null counts as empty); equal texts share it."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
