"""What the training-data operators share: table reading and results that are written out between steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from loomwell.functions import tables
from loomwell.functions.tables import sent_if_few, shared_folder

__all__ = ["checkpointed", "sent_if_few", "shared_folder", "step", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system Spark knows will do."""
    return tables.read(spark, f"{sf_dir}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tables that were written since the current step of this thread began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it from there.

    That cuts the lineage, outlives executors, and lets Spark plan what follows with the true size. In loops of joins
    a plan that starts at files stays small, where checkpoints pass on orderings that double each time round.
    """
    session = df.sparkSession
    # Python gets its rows in small batches, so that workers need little memory beside the executor's own.
    usual = session.conf.get(BATCH, None)
    session.conf.set(BATCH, str(8 << 20))
    try:
        out = tables.written(df, path := f"{shared_folder(session)}/loomwell-{uuid.uuid4().hex}")
    finally:
        session.conf.unset(BATCH) if usual is None else session.conf.set(BATCH, usual)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return out


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end or when it fails, the tables that were written within it: for steps whose own result is
    written out. Tables of other threads' steps are not touched."""
    outer = _MADE.set([])
    try:
        yield
    finally:
        for path in _MADE.get():
            tables.delete(spark, path)
        _MADE.reset(outer)
