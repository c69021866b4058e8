"""Intermediate tables in the folder that driver and executors share, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only where none is set and all runs in one process (tests) is a temporary folder made."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "folder" not in _OWN:
        _OWN["folder"] = tempfile.mkdtemp(prefix="spark-ckpt-")
    return _OWN["folder"]


#: Bytes of a table up to which its rows are dealt out to all cores: less than a file's split, so one task would read all.
SMALL = 24 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table. A small one, which may be one split, is dealt out, so that work on its rows takes all cores; larger
    ones are read as they are split."""
    df = spark.read.parquet(path)
    few = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL
    return df.repartition(spark.sparkContext.defaultParallelism) if few else df


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and what follows is planned with its true size."""
    path = path or f"{shared_folder(df.sparkSession)}/loomwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written in here gives Python its rows in small batches, however long they are."""
    usual = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(8 << 20))
    try:
        yield
    finally:
        if usual is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, usual)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system it is."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path and all below it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def sent_if_few(df: DataFrame, most: int) -> DataFrame:
    """``df``, a written table, marked for a broadcast join if its rows, which are counted, are at most ``most``."""
    return F.broadcast(df) if df.count() <= most else df
