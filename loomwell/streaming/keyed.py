"""Tables with a key that are kept up in place: what a batch cannot touch is neither read nor written.

Layout: ``data/<part>/bucket=<n>`` holds rows whose key's hash falls in the bucket; ``manifest/version=<n>`` lists the live
(bucket, part) pairs, each with its number of rows and a Bloom filter of its keys. A write makes a new part and then a
new manifest, one small file that appears at once: readers see the table before or after it, and a writer that fails
leaves the old one. A manifest may carry a tag, such as the number of a stream's batch, by which a repeated write is
known.

Inserts look keys up in the filters first; only buckets in which a key may be are read, and new rows become a part of
their own. Upserts read and rewrite the buckets that their keys fall in. Keys are compared so that null equals null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import tables

#: Bits of a filter (a power of two, at least 64) and places of a key in it; parts of a bucket before they are put together.
BITS, PLACES, MOST_PARTS = 1 << 17, 5, 8
MANIFEST = "bucket int, part string, n long, filter binary, tag long"


@dataclass(frozen=True)
class KeyedTable:
    """A version of the table at ``path``: rows of ``schema`` by ``key``, in ``buckets`` buckets."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    buckets: int
    version: int = 0
    tag: int | None = None
    #: (bucket, part, rows, filter) of what is live.
    parts: tuple[tuple[int, str, int, bytes], ...] = field(default=(), repr=False)

    def rows(self, buckets: set[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets: no other files are opened."""
        paths = [f"{self.path}/data/{part}/bucket={b}" for b, part, *_ in self.parts if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")


def open_table(spark: SparkSession, path: str, key: str, schema: str, buckets: int = 32) -> KeyedTable:
    """The latest version; an empty table where there is none. ``buckets`` is fixed when the first rows are written."""
    if not tables.exists(spark, f"{path}/manifest"):
        return KeyedTable(spark, path, key, schema, buckets)
    rows = spark.read.schema(f"{MANIFEST}, buckets int, version int").parquet(f"{path}/manifest")
    live = rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version").collect()  # a row a bucket and part
    parts = tuple(sorted((r["bucket"], r["part"], r["n"], bytes(r["filter"])) for r in live if r["part"]))
    return KeyedTable(spark, path, key, schema, live[0]["buckets"], live[0]["version"], live[0]["tag"], parts)


def _places(key: str) -> Column:
    """The bits of a key in its bucket's filter."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), key), F.lit(BITS)).cast("int") for i in range(PLACES)))


def _written(table: KeyedTable, rows: DataFrame) -> list[tuple[int, str, int, bytes]]:
    """A new part with ``rows``, and what the manifest says of it."""
    part = uuid.uuid4().hex
    rows.withColumn("bucket", table.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{table.path}/data/{part}")
    if not tables.exists(table.spark, f"{table.path}/data/{part}/_SUCCESS"):
        raise OSError(f"the part {part} was not written")
    made = table.spark.read.schema(f"{table.schema}, bucket int").parquet(f"{table.path}/data/{part}")
    sizes = {r["bucket"]: r["n"] for r in made.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    filters = {b: np.zeros(BITS // 64, np.uint64) for b in sizes}
    bits = made.select("bucket", F.explode(_places(table.key)).alias("at"))
    # At most BITS / 64 words a bucket.
    words = bits.groupBy("bucket", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("set"))
    for r in words.toLocalIterator():
        filters[r["bucket"]][r["word"]] = np.int64(r["set"]).view(np.uint64)
    return [(b, part, n, filters[b].tobytes()) for b, n in sorted(sizes.items())]


def _committed(table: KeyedTable, parts: list[tuple[int, str, int, bytes]], tag: int | None) -> KeyedTable:
    rows = [(*p, tag, table.buckets) for p in parts] or [(-1, None, 0, b"", tag, table.buckets)]
    live = table.spark.createDataFrame(rows, f"{MANIFEST}, buckets int")
    live.coalesce(1).write.mode("overwrite").parquet(f"{table.path}/manifest/version={table.version + 1}")
    return open_table(table.spark, table.path, table.key, table.schema, table.buckets)


def _may_be_there(table: KeyedTable, batch: DataFrame) -> DataFrame:
    """``batch`` with its bucket and whether a filter of it has the key."""
    filters: dict[int, list] = {}
    for bucket, _, _, bits in table.parts:
        filters.setdefault(bucket, []).append(np.frombuffer(bits, np.uint64))
    sent = table.spark.sparkContext.broadcast({b: np.stack(f) for b, f in filters.items()})

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in found:
            at = np.array(rows.column("_places").to_pylist(), np.int64).reshape(-1, PLACES)
            bucket, hit = rows.column("_bucket").to_numpy(zero_copy_only=False), np.zeros(len(at), bool)
            for b in np.unique(bucket):
                if (bits := sent.value.get(int(b))) is not None:
                    mine = at[bucket == b]
                    hit[bucket == b] = (bits[:, mine >> 6] >> (mine & 63).astype(np.uint64) & np.uint64(1)).all(axis=2).any(axis=0)
            yield rows.append_column("_may", pa.array(hit))

    given = batch.withColumn("_bucket", table.bucket()).withColumn("_places", _places(table.key))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(batches, f"{kinds}, _may boolean").drop("_places")


def insert(table: KeyedTable, batch: DataFrame, order: str, tag: int | None = None) -> KeyedTable:
    """The table with the rows of ``batch`` whose key it does not have; of equal new keys the first by ``order``."""
    if tag is not None and table.tag is not None and tag <= table.tag:
        return table
    # A struct orders rows whose order is null, too.
    first = batch.groupBy(table.key).agg(F.min_by(F.struct(*batch.columns), F.struct(order)).alias("_r")).select("_r.*")
    told = tables.written(_may_be_there(table, first))
    touched = {r[0] for r in told.where("_may").select("_bucket").distinct().collect()}  # at most as many as buckets
    there = table.rows(touched).select(F.col(table.key).alias("_key"))
    maybe = told.where("_may").join(there, F.col(table.key).eqNullSafe(F.col("_key")), "left_anti")
    new = told.where("not _may").unionByName(maybe).select(batch.columns)
    # Buckets in many parts are put together, with what is new in them.
    counts: dict[int, int] = {}
    for bucket, *_ in table.parts:
        counts[bucket] = counts.get(bucket, 0) + 1
    full = {b for b, n in counts.items() if n >= MOST_PARTS}
    made = _written(table, new.unionByName(table.rows(full).select(batch.columns)) if full else new)
    return _committed(table, [p for p in table.parts if p[0] not in full] + made, tag)


def upsert(table: KeyedTable, batch: DataFrame, order: str, tag: int | None = None) -> KeyedTable:
    """The table with the rows of ``batch`` in place of those with their keys; of equal keys the last by ``order``."""
    if tag is not None and table.tag is not None and tag <= table.tag:
        return table
    last = tables.written(batch.groupBy(table.key).agg(F.max_by(F.struct(*batch.columns), F.struct(order)).alias("_r")).select("_r.*"))
    touched = {r[0] for r in last.select(table.bucket()).distinct().collect()}
    given = last.select(F.col(table.key).alias("_key"))
    kept = table.rows(touched).select(batch.columns)
    kept = kept.join(given, F.col(table.key).eqNullSafe(F.col("_key")), "left_anti")
    made = _written(table, last.unionByName(kept))
    return _committed(table, [p for p in table.parts if p[0] not in touched] + made, tag)


def vacuum(table: KeyedTable) -> int:
    """Remove parts that the latest version does not name; returns how many there were."""
    spark, live = table.spark, {part for _, part, *_ in table.parts}
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table.path}/data")
    there = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    gone = [name for name in there if name not in live]
    for name in gone:
        tables.delete(spark, f"{table.path}/data/{name}")
    return len(gone)


