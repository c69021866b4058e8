"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Index: vectors go to the cell of the nearest of some centres (k-means of a bounded sample), what is left of them beside
the centre is rotated by a random orthogonal matrix into ``BITS_PER_DIM`` times as many dimensions, and the signs are
its code. With u the rotated direction and b the unit vector of its signs, <b, q> / <b, u> estimates <u, q> for any
query q without bias, with a deviation of sqrt((1 - <b, u>^2) / <b, u>^2 / (bits - 1)) |q|. So a row keeps its packed
bits and two scalars: the length of its rest over <b, u>, and the deviation at that length. Cells of more than
``PART_ROWS`` rows are dealt out over several parts.

Search: every query first meets the parts of its own cell. Its k-th best product there is a bound: it then visits only
parts whose greatest possible product with it, by the centre and the longest rest, reaches the bound. In a part the
products of queries and rows are estimated from the bits; the exact products of the best estimates raise the bound;
rows whose estimate plus ``DEVIATIONS`` deviations reaches it are reranked with their exact products in double
precision. No number of candidates is capped.

Equal vectors are one class: of its rows only the k + 1 smallest ids can ever be among a query's k nearest, so these are
indexed, and a class of query rows is searched for once. Queries meet parts in groups of some ``SLICE_QUERIES`` queries
of one cell and ``PART_ROWS`` rows; results are cut to k + 1 for each query before they are shuffled.

Recall against brute force (tests, README) is 0.99 and more: only the estimates' deviations can lose a row.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite components, and vectors of another
length than most (the smaller one of equally frequent lengths), take no part; a query is a row whose id divides by
``every``, its own row is what has its id and vector; rows given twice count once; an id with several vectors is a
query and a candidate with each; a null id is a candidate, last of a tie; ties go to the smaller id; with fewer than k
candidates all are returned; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.llm.common import checkpointed, table

K, EVERY = 20, 20
#: Rows of the sample that centres are fitted on (those of the smallest hashes), rows for each centre, most centres, rounds.
SAMPLE, CELL_ROWS, MOST_CELLS, ROUNDS = 16_384, 4096, 1024, 8
#: Bits for each dimension (the code is a multiple of 64 bits), deviations at which an estimate is trusted to rule out.
BITS_PER_DIM, DEVIATIONS = 4, 3.0
#: Rows of a part of a cell, queries of a slice, and queries that a task compares at once.
PART_ROWS, SLICE_QUERIES, AT_ONCE = 4096, 4096, 256
SEED = 20

CODED = "cell int, vec_id long, h1 long, h2 long, v array<double>, bits binary, scale double, deviation double, rest double"
VISIT = "part int, slice int, h1 long, h2 long, v array<double>, bound double"
FOUND = "h1 long, h2 long, vec_id long, c1 long, c2 long, score double"


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


class Model:
    """Centres of the cells and the rotation."""

    def __init__(self, sample: np.ndarray, cells: int, dim: int) -> None:
        rng = np.random.default_rng(SEED)
        self.dim, self.bits = dim, -(-dim * BITS_PER_DIM // 64) * 64
        centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
        for _ in range(ROUNDS if len(centres) > 1 else 0):
            of = nearest_centre(sample, centres)
            sums, n = np.zeros_like(centres), np.bincount(of, minlength=len(centres))
            np.add.at(sums, of, sample)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        self.centres = centres if len(centres) > 1 else sample.mean(axis=0, keepdims=True)
        q, r = np.linalg.qr(rng.standard_normal((self.bits, dim)))
        self.rotation = q * np.sign(np.diag(r))

    def code(self, x: np.ndarray) -> tuple:
        """Cells, packed bits, scales, deviations and lengths of the rest."""
        cell = nearest_centre(x, self.centres)
        rest = x - self.centres[cell]
        length = np.linalg.norm(rest, axis=1)
        turned = rest / np.where(length > 0, length, 1)[:, None] @ self.rotation.T
        match = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(self.bits), 1e-9)
        deviation = np.sqrt(np.maximum(1 - match**2, 0)) / match / np.sqrt(self.bits - 1)
        return cell, np.packbits(turned > 0, axis=1), np.where(length > 0, length / match, 0.0), deviation * length, length


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), dim) for c in chunks]
    return np.concatenate(parts).astype(np.float64, copy=False) if parts else np.zeros((0, dim))


def rows_of(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def searched(model: Model, queries: dict, rows: dict, k: int) -> dict:
    """The at most k best rows of one part for each query: exact products of what the estimates leave."""
    n, dim = len(rows["x"]), model.dim
    signs = (np.unpackbits(rows["bits"], axis=1)[:, : model.bits].astype(np.float32) * 2 - 1).T / np.float32(np.sqrt(model.bits))
    scale, deviation = rows["scale"], rows["deviation"] * DEVIATIONS
    out: list[tuple] = []
    for lo in range(0, len(queries["q"]), AT_ONCE):
        q = queries["q"][lo : lo + AT_ONCE]
        size = np.linalg.norm(q, axis=1)
        slack = size * (np.linalg.norm(rows["centre"]) + rows["rest"].max(initial=0)) * 1e-5
        # Directions in single precision, lengths, which may be of any size, in double.
        turned = (q / size[:, None] @ model.rotation.T).astype(np.float32)
        estimate = (q @ rows["centre"])[:, None] + (turned @ signs).astype(np.float64) * size[:, None] * scale
        bound = queries["bound"][lo : lo + AT_ONCE]
        if n >= k:
            best = np.argpartition(-estimate, k - 1, axis=1)[:, :k]
            bound = np.maximum(bound, (q[:, None] * rows["x"][best]).sum(axis=2).min(axis=1))
        at, row = np.nonzero(estimate + size[:, None] * deviation >= (bound - slack)[:, None])
        for a in range(0, len(at), 1 << 18):
            i, j = at[a : a + (1 << 18)], row[a : a + (1 << 18)]
            score = (q[i] * rows["x"][j]).sum(axis=1)
            good = score >= bound[i]
            out.append((i[good] + lo, j[good], score[good]))
    at, row, score = (np.concatenate(c) if out else np.zeros(0, t) for c, t in zip(zip(*out) if out else ((), (), ()), (int, int, float)))
    order = np.lexsort((rows["vec_id"][row], -score, at))
    at, row, score = at[order], row[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return {"at": at[place < k], "row": row[place < k], "score": score[place < k]}


class Index:
    """Coded vectors dealt out to parts, as tables in the shared folder, and the model in every task."""

    def __init__(self, vectors: DataFrame, rows: int, dim: int, k: int) -> None:
        """``vectors``: (vec_id, h1, h2, v), with the k smallest ids of equal vectors."""
        spark = vectors.sparkSession
        sample = vectors.orderBy(F.xxhash64("vec_id", "h1"), "h1", "h2", "vec_id").limit(SAMPLE).select("v").toArrow()
        cells = int(np.clip(rows // CELL_ROWS, 1, MOST_CELLS))
        self.k, self.dim = k, dim
        self.model = spark.sparkContext.broadcast(Model(matrix(sample.column(0), dim), cells, dim))
        self.coded = checkpointed(vectors.mapInArrow(self._coded, CODED))
        # One row for each cell: where its parts begin, how many there are, and the longest rest in them.
        stats = {r["cell"]: r for r in self.coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("rest")).collect()}
        cells = len(self.model.value.centres)
        self.parts = np.array([-(-stats[c]["n"] // PART_ROWS) if c in stats else 0 for c in range(cells)])
        self.first = np.concatenate([[0], self.parts.cumsum()])[:-1]
        self.reach = np.array([stats[c]["rest"] if c in stats else 0.0 for c in range(cells)])
        at = lambda values: F.get(F.array(*(F.lit(int(x)) for x in values)), F.col("cell"))
        self.placed = self.coded.select((at(self.first) + F.pmod(F.xxhash64("h2", "vec_id"), at(self.parts)).cast("int")).alias("part"), *self.coded.columns)

    def _coded(self, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), self.dim)
            cell, bits, scale, deviation, rest = self.model.value.code(x)
            packed = pa.array([b.tobytes() for b in bits], pa.binary())
            yield pa.record_batch([pa.array(cell, pa.int32()), batch.column("vec_id"), batch.column("h1"), batch.column("h2"), rows_of(x), packed, pa.array(scale), pa.array(deviation), pa.array(rest)], names=[f.split()[0] for f in CODED.split(", ")])

    def visits(self, queries: DataFrame, slices: int, home: bool) -> DataFrame:
        """The parts that each query (h1, h2, v, bound) visits: those of its own cell, or of others that may reach its bound."""
        first, parts, reach, dim, model = self.first, self.parts, self.reach, self.dim, self.model

        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                for lo in range(0, batch.num_rows, AT_ONCE):
                    piece = batch.slice(lo, AT_ONCE)
                    q, centres = matrix(piece.column("v"), dim), model.value.centres
                    own, size = nearest_centre(q, centres), np.linalg.norm(q, axis=1)
                    bound = piece.column("bound").to_numpy(zero_copy_only=False)
                    h1 = piece.column("h1").to_numpy(zero_copy_only=False)
                    goes = np.arange(len(centres)) == own[:, None]
                    if not home:
                        goes = ~goes & (q @ centres.T + size[:, None] * reach + 1e-9 * size[:, None] * (1 + reach) >= bound[:, None])
                    at, cell = np.nonzero(goes & (parts > 0))
                    times = parts[cell]
                    part = np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
                    at = np.repeat(at, times)
                    # Queries of one cell share their slices, so that a slice visits few parts; small cells share one.
                    each = -(-slices // len(centres))
                    slice_of = own * slices // len(centres) if each == 1 else own * each + h1 % each
                    for a in range(0, len(at), 8192):
                        i = at[a : a + 8192]
                        yield pa.record_batch([pa.array(part[a : a + 8192], pa.int32()), pa.array(slice_of[i], pa.int32()), pa.array(h1[i]), piece.column("h2").take(pa.array(i)), rows_of(q[i]), pa.array(bound[i])], names=[f.split()[0] for f in VISIT.split(", ")])

        return queries.select("h1", "h2", "v", "bound").mapInArrow(batches, VISIT)

    def search(self, visits: DataFrame) -> DataFrame:
        """The k best rows that each query finds in each part that it visits."""
        visits = checkpointed(visits)
        # A part is sent to the slices that visit it, and to no others.
        sent = self.placed.join(visits.select("part", F.col("slice").alias("to")).distinct(), "part")
        model, dim, k = self.model, self.dim, self.k

        def group(left: pa.Table, right: pa.Table) -> pa.Table:
            to_numpy = lambda t, c: t.column(c).to_numpy()
            ids = left.column("vec_id").to_numpy()
            rows = {"x": matrix(left.column("v"), dim), "bits": np.frombuffer(b"".join(left.column("bits").to_pylist()), np.uint8).reshape(len(left), -1), "vec_id": np.where(np.isnan(ids), np.inf, ids) if ids.dtype.kind == "f" else ids}
            rows |= {c: to_numpy(left, c) for c in ("scale", "deviation", "rest")}
            hits: dict = {c: [] for c in ("at", "row", "score")}
            if len(left) and len(right):
                rows["centre"] = model.value.centres[left.column("cell")[0].as_py()]
                hits = searched(model.value, {"q": matrix(right.column("v"), dim), "bound": to_numpy(right, "bound")}, rows, k)
            at, row = pa.array(hits["at"], pa.int64()), pa.array(hits["row"], pa.int64())
            return pa.table([right.column("h1").take(at), right.column("h2").take(at), left.column("vec_id").take(row), left.column("h1").take(row), left.column("h2").take(row), pa.array(hits["score"], pa.float64())], names=[f.split()[0] for f in FOUND.split(", ")])

        found = sent.groupBy("part", "to").cogroup(visits.groupBy("part", "slice")).applyInArrow(group, FOUND)
        return checkpointed(best(found, self.k))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query so far: the rank limit is applied in each task before the shuffle."""
    first = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c1", "c2")
    return found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")


def search(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row whose id divides by ``every``."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).where(usable(F.col("v")))
    sizes = given.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d"), F.max("n").alias("n")).first()
    if sizes["d"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Two hashes name a vector.
    named = given.where(F.size("v") == sizes["d"]).select("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2"), "v")
    alike = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("vec_id"))
    # The rank by id tells rows given twice apart from copies under other ids; both limits are applied before the shuffle.
    classes = checkpointed(named.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k + 1).drop("_r"))
    asked = checkpointed(named.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "h1", "h2"]))
    queries = checkpointed(asked.dropDuplicates(["h1", "h2"]).select("h1", "h2", "v", F.lit(float("-inf")).alias("bound")))
    index = Index(classes, sizes["n"], sizes["d"], k + 1)
    slices = max(1, -(-queries.count() // SLICE_QUERIES))
    near = index.search(index.visits(queries, slices, home=True))
    bounds = near.groupBy("h1", "h2").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("b"))
    bounded = queries.join(bounds, ["h1", "h2"], "left").select("h1", "h2", "v", F.coalesce("b", "bound").alias("bound"))
    found = near.unionByName(index.search(index.visits(bounded, slices, home=False)))
    answers = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(best(found, k + 1), ["h1", "h2"])
    other = answers.where(~((F.col("vec_id").eqNullSafe(F.col("query_id"))) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))))
    place = Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c1", "c2")
    return other.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_one_bit_search": op13_one_bit_search}
