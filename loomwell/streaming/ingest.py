"""Insert-if-absent ingestion, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.streaming import keyed


def new_rows(batch: DataFrame, existing: DataFrame | None, order: str = "seq") -> DataFrame:
    """The rows of ``batch`` whose content hash is new; the first of equals. A null hash is a value like any other."""
    first = batch.groupBy("content_hash").agg(F.min_by(F.struct(*batch.columns), F.struct(order)).alias("_r")).select("_r.*")
    if existing is None:
        return first
    there = existing.select(F.col("content_hash").alias("_h"))
    return first.join(there, first["content_hash"].eqNullSafe(there["_h"]), "left_anti")


def changed_titles(changes: DataFrame, watermark) -> DataFrame:
    """Titles edited or created after the watermark, each once."""
    return changes.where(F.col("type").isin("edit", "new") & (F.col("ts") > F.lit(watermark))).select("title").distinct()


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: replace on write."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, order).alias("r")).select("r.*")


def ingest_stream(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, order: str = "seq") -> keyed.KeyedTable:
    """Take up all files that have landed and insert rows with new content hashes into the keyed table at ``target``.

    Files are read once (the checkpoint knows them); the table keeps the number of its last batch, so one that is repeated
    after a failure changes nothing. Of the table, only buckets in which a hash may be are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        keyed.insert(keyed.open_table(spark, target, "content_hash", schema), batch, order, number)

    stream = spark.readStream.schema(schema).parquet(landing)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return keyed.open_table(spark, target, "content_hash", schema)
