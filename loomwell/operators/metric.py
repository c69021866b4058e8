"""Exact nearest neighbours by cells: what the triangle inequality rules out is never compared.

Vectors lie in the cell of the nearest of some centres (Lloyd rounds over a bounded sample), with their distance to it.
For a query at distance d from a centre, a row of that cell at distance r from the centre is at least |d - r| away. So a
query first meets its own cell, which gives a distance that its k nearest rows do not exceed; then it meets the cells,
and in them the rows, that can be within that distance. The rows returned are those of a full comparison.

Neighbouring cells make a zone of some ``PART_ROWS`` rows; larger cells are dealt out over parts, a zone each. Rows of a
zone and a slice of the queries that have to look at it meet in one group, whose distances are matrix products; the
few pairs that may be among the nearest get their distance computed term by term, and a group hands on k a query.

Vectors that are searched once need no index: see ``Unindexed``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import tables

#: Rows that centres are fitted on, rows of a cell aimed at, most cells, rounds, rows of a part.
SAMPLE, CELL_ROWS, MOST_CELLS, ROUNDS, PART_ROWS = 16_384, 500, 512, 6, 1 << 14
#: Queries of a slice, those compared side by side, and pairs whose exact distances are computed side by side.
SLICE, SIDE_BY_SIDE, PAIRS = 4096, 256, 1 << 16


@dataclass(frozen=True)
class MetricIndex:
    """Rows (id, cell, part, r, embedding) and, for each cell, its centre, the longest r, its parts, rows and first zone."""

    rows: DataFrame
    centres: Broadcast
    reach: tuple[float, ...]
    parts: tuple[int, ...]
    counts: tuple[int, ...]
    zones: tuple[int, ...]


class Unindexed:
    """Vectors that are searched once: each task compares its rows with all queries of their length, a batch at a time, and
    hands on the nearest ones. More than ``SLICE`` queries, which are counted, make an index."""

    def __init__(self, vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> None:
        self.vectors, self.id_column, self.vector, self.index = vectors, id_column, vector, None

    def made(self) -> MetricIndex:
        self.index = self.index or build(self.vectors, self.id_column, self.vector)
        return self.index


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), 0))


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    centres = sample[:: max(1, len(sample) // cells)][:cells]
    for _ in range(ROUNDS if cells > 1 else 0):
        of = _distances(sample, centres).argmin(axis=1)
        n, sums = np.bincount(of, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(sums, of, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> MetricIndex:
    """An index of vectors of one length; rows without a vector, or with another length than the sample's first, are left out."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("embedding")).where(F.col("embedding").isNotNull())
    sample = given.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    dim = len(sample.column("embedding")[0]) if len(sample) else 0
    given = given.where(F.size("embedding") == dim)
    kept = [v for v in sample.column("embedding").to_pylist() if len(v) == dim]
    centres = spark.sparkContext.broadcast(_centres(np.array(kept, dtype=np.float64).reshape(len(kept), dim), int(np.clip(given.count() // CELL_ROWS, 1, MOST_CELLS))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("embedding")), centres.value)
                cell = d.argmin(axis=1)
                yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column("r", pa.array(d[np.arange(len(cell)), cell]))

    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    rows = tables.written(given.mapInArrow(placed, f"id {kinds['id']}, embedding {kinds['embedding']}, cell int, r double"))
    stats = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).collect()}  # a row a cell
    cells = range(len(centres.value))
    parts = tuple(-(-stats[c]["n"] // PART_ROWS) if c in stats else 0 for c in cells)
    part = F.pmod(F.xxhash64("id"), F.get(F.array(*map(F.lit, parts)), F.col("cell"))) if parts else F.lit(0)
    counts = tuple(stats[c]["n"] if c in stats else 0 for c in cells)
    reach = tuple(stats[c]["r"] if c in stats else 0.0 for c in cells)
    return MetricIndex(rows.withColumn("part", part.cast("int")), centres, reach, parts, counts, _zones(counts, parts))


def _zones(counts: tuple[int, ...], parts: tuple[int, ...]) -> tuple[int, ...]:
    """The first zone of each cell: cells of one part share a zone while it has up to ``PART_ROWS`` rows."""
    zones, zone, filled = [], 0, 0
    for n, k in zip(counts, parts):
        if filled and filled + n > PART_ROWS:
            zone, filled = zone + 1, 0
        zones.append(zone)
        zone, filled = (zone + k, 0) if k > 1 else (zone, filled + n)
    return tuple(zones)


def _goes(reach: np.ndarray, parts: np.ndarray, d: np.ndarray, own: np.ndarray, least: np.ndarray, home: bool) -> np.ndarray:
    """Which cells each query, ``d`` away from the centres, has to look at: its own one, or all others within ``least``."""
    mine = np.arange(d.shape[1]) == own[:, None]
    return mine if home else ~mine & (parts > 0) & (d - reach <= least[:, None] * (1 + 1e-9) + 1e-9)


def _asked(index: MetricIndex, queries: DataFrame) -> DataFrame:
    """Queries that have a vector of the index's length; others have no nearest rows."""
    return queries.where(F.size("q") == index.centres.value.shape[1]) if index.parts else queries.limit(0)


def _visits(index: MetricIndex, queries: DataFrame, home: bool, slices: int) -> DataFrame:
    """(q_id, q, least, own, zone, slice): the zones that each query (q_id, q, least) has to look at, and its own cell."""
    centres, reach, parts, zones = index.centres, np.array(index.reach), np.array(index.parts, dtype=np.int64), np.array(index.zones, dtype=np.int64)
    # A row for each zone of a cell.
    of = np.repeat(np.arange(len(parts)), parts)
    zone = zones[of] + (np.arange(len(of)) - np.searchsorted(of, of))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for start in range(0, whole.num_rows, SIDE_BY_SIDE):
                batch = whole.slice(start, SIDE_BY_SIDE)
                d = _distances(_matrix(batch.column("q")), centres.value)
                own = np.where(parts > 0, d, np.inf).argmin(axis=1)
                at, cell = np.nonzero(_goes(reach, parts, d, own, batch.column("least").to_numpy(zero_copy_only=False), home)[:, of])
                to = np.unique(np.stack([at, zone[cell]], axis=1), axis=0)
                yield batch.take(pa.array(to[:, 0])).append_column("own", pa.array(own[to[:, 0]], pa.int32())).append_column("zone", pa.array(to[:, 1], pa.int32()))

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    found = queries.select("q_id", "q", "least").mapInArrow(batches, f"q_id {kinds['q_id']}, q {kinds['q']}, least double, own int, zone int")
    return found.withColumn("slice", F.pmod(F.xxhash64("q_id"), F.lit(slices)).cast("int"))


def _cut(q: np.ndarray, row: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest pairs of each query, of equal ones the smaller rows."""
    order = np.lexsort((row, distance, q))
    q, row, distance = q[order], row[order], distance[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], row[first], distance[first]


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, added up in the order of the components."""
    return np.cumsum((x - y) ** 2, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _near(x: np.ndarray, size: np.ndarray, q: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of pairs within ``most``, a query's ``k`` nearest of the rows among them."""
    own_size = (q**2).sum(axis=1)[:, None]
    near = size - 2 * q @ x.T + own_size
    slack = 1e-11 * (own_size + size.max()) + 1e-300
    bound = most[:, None].copy()
    if len(x) > k and (wide := np.count_nonzero(near <= bound + slack, axis=1) > k).any():
        bound[wide, 0] = np.minimum(bound[wide, 0], np.partition(near[wide], k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero(near <= bound + slack)
    return i, j, np.concatenate([np.zeros(0), *(_exact(x[j[n : n + PAIRS]], q[i[n : n + PAIRS]]) for n in range(0, len(i), PAIRS))])


def _passed(sent: Broadcast, k: int):
    """A task's nearest rows: (q_id, id, distance), ``k`` a query."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = (sent.value.column(c).combine_chunks() for c in ("q_id", "q"))
        dims, best = vectors.value_lengths().to_numpy(), None
        asked = {dim: (np.flatnonzero(dims == dim), _matrix(vectors.take(pa.array(np.flatnonzero(dims == dim))))) for dim in np.unique(dims)}
        most = np.full(len(ids), np.inf)
        for batch in found:
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dim, (of, q) in asked.items():
                mine = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                x, row = _matrix(mine.column("embedding")) if mine.num_rows else np.zeros((0, dim)), mine.column("id").to_numpy(zero_copy_only=False)
                x, row = x[np.isfinite(x).all(axis=1)], row[np.isfinite(x).all(axis=1)]
                for at in range(0, len(of) if len(x) else 0, SIDE_BY_SIDE):
                    some = of[at : at + SIDE_BY_SIDE]
                    i, j, distance = _near(x, (x**2).sum(axis=1), q[at : at + SIDE_BY_SIDE], most[some], k)
                    new = some[i], row[j], distance
                    asked_of, rows, distance = new if best is None else map(np.concatenate, zip(best, new))
                    # Ids of any kind are compared by their places.
                    known, place = np.unique(rows, return_inverse=True)
                    cut, place, distance = _cut(asked_of, place.ravel(), distance, k)
                    best = cut, known[place], distance
                    # What a query's k-th row has, rows of later batches must reach.
                    full = np.flatnonzero(np.arange(len(cut)) - np.searchsorted(cut, cut) == k - 1)
                    most[cut[full]] = distance[full] * (1 + 1e-9)
        if best is not None:
            yield pa.record_batch([ids.take(pa.array(best[0])), pa.array(best[1], batch.schema.field("id").type), pa.array(best[2])], names=["q_id", "id", "distance"])

    return batches


def _nearest(index: MetricIndex, home: bool, k: int):
    """A group's nearest rows: (q_id, id, distance), ``k`` a query."""
    centres, reach, parts = index.centres, np.array(index.reach), np.array(index.parts, dtype=np.int64)

    def found(rows: pa.Table, queries: pa.Table) -> pa.Table:
        # By id, so that of equal distances the first row counts; of equal vectors only the k first ids can be nearest.
        rows = rows.sort_by([("id", "ascending")]) if queries.num_rows else rows.slice(0, 0)
        queries = queries if rows.num_rows else queries.slice(0, 0)
        x, q = (_matrix(t.column(c).combine_chunks()) if t.num_rows else np.zeros((0, 0)) for t, c in ((rows, "embedding"), (queries, "q")))
        keep = np.arange(len(x))
        if len(x):
            same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
            order = np.argsort(same, kind="stable")
            keep = np.sort(order[np.arange(len(order)) - np.searchsorted(same[order], same[order]) < k])
        cells, least, own = rows.column("cell").to_numpy()[keep], queries.column("least").to_numpy(), queries.column("own").to_numpy()
        goes = _goes(reach, parts, _distances(q, centres.value), own, least, home) if len(q) else None
        best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        size, most = (x**2).sum(axis=1), least**2 * (1 + 1e-9)
        for cell in np.unique(cells):
            mine, asked = keep[cells == cell], np.flatnonzero(goes[:, cell])
            for at in range(0, len(asked), SIDE_BY_SIDE):
                some = asked[at : at + SIDE_BY_SIDE]
                i, j, pairs = _near(x[mine], size[mine], q[some], most[some], k)
                if len(i):
                    new = _cut(some[i], mine[j], pairs, k)
                    best = tuple(map(np.concatenate, zip(best, new)))
                    # What a query's k-th row has, rows of later cells must reach.
                    full = np.flatnonzero(np.arange(len(new[0])) - np.searchsorted(new[0], new[0]) == k - 1)
                    most[new[0][full]] = np.minimum(most[new[0][full]], new[2][full] * (1 + 1e-9))
        of, row, distance = _cut(*best, k)
        return pa.table({"q_id": queries.column("q_id").take(pa.array(of)), "id": rows.column("id").take(pa.array(row)), "distance": pa.array(distance)})

    return found


def _compared(index: MetricIndex, queries: DataFrame, home: bool, k: int, allowed: DataFrame | None, slices: int) -> DataFrame:
    """(q_id, id, distance): the nearest of the rows that a query has to look at, ``k`` of each zone, by squared distance."""
    rows = index.rows if allowed is None else index.rows.join(allowed.select(F.col("doc").alias("id")), "id", "left_semi")
    zone = F.get(F.array(*map(F.lit, index.zones)), F.col("cell")) + F.col("part") if index.zones else F.lit(0)
    rows = rows.select("id", "embedding", "cell", zone.cast("int").alias("zone"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    visits = _visits(index, queries, home, slices)
    kinds = {f.name: f.dataType.simpleString() for f in (*rows.schema, *visits.schema)}
    both = rows.groupBy("zone", "slice").cogroup(visits.groupBy("zone", "slice"))
    return both.applyInArrow(_nearest(index, home, k), f"q_id {kinds['q_id']}, id {kinds['id']}, distance double")


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "id"))
    return found.select("q_id", "id", "distance", rank.alias("rank")).where(F.col("rank") <= k)


def search(index: MetricIndex | Unindexed, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(q_id, id, distance, rank): the ``k`` nearest rows of each query (q_id, q) by squared distance, ties by id.

    ``allowed`` (doc) leaves rows out.
    """
    if isinstance(index, Unindexed):
        asked = queries.select("q_id", "q").where(F.col("q").isNotNull())
        if index.index is not None or asked.count() > SLICE:
            return search(index.made(), queries, k, allowed)
        rows = index.vectors.select(F.col(index.id_column).alias("id"), F.col(index.vector).alias("embedding")).where(F.col("embedding").isNotNull())
        rows = rows if allowed is None else rows.join(allowed.select(F.col("doc").alias("id")), "id", "left_semi")
        kinds = {f.name: f.dataType.simpleString() for f in (*rows.schema, *asked.schema)}
        sent = queries.sparkSession.sparkContext.broadcast(asked.toArrow())
        return _first(rows.mapInArrow(_passed(sent, k), f"q_id {kinds['q_id']}, id {kinds['id']}, distance double"), k)
    queries = _asked(index, queries)
    slices = max(1, -(-queries.count() // SLICE))
    near = tables.written(_first(_compared(index, queries.select("q_id", "q", F.lit(float("inf")).alias("least")), True, k, allowed, slices), k))
    return _first(near.drop("rank").unionByName(_compared(index, _bounded(queries, near, k), False, k, allowed, slices)), k)


def _bounded(queries: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(q_id, q, least): what a query's ``k`` nearest rows do not exceed."""
    bound = near.where(F.col("rank") == k).select("q_id", F.sqrt("distance").alias("least"))
    return queries.select("q_id", "q").join(bound, "q_id", "left").withColumn("least", F.coalesce("least", F.lit(float("inf"))))


def compared(index: MetricIndex, queries: DataFrame, k: int) -> int:
    """How many distances ``search`` computes."""
    queries, centres, reach, parts, counts = _asked(index, queries), index.centres, np.array(index.reach), np.array(index.parts, dtype=np.int64), np.array(index.counts, dtype=np.int64)

    def counted(asked: DataFrame, home: bool) -> int:
        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                d = _distances(_matrix(batch.column("q")), centres.value)
                own = np.where(parts > 0, d, np.inf).argmin(axis=1)
                n = _goes(reach, parts, d, own, batch.column("least").to_numpy(zero_copy_only=False), home) @ counts
                yield pa.record_batch([pa.array([int(n.sum())])], names=["n"])

        return asked.select("q", "least").mapInArrow(batches, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    asked = queries.select("q_id", "q", F.lit(float("inf")).alias("least"))
    near = _first(_compared(index, asked, True, k, None, 1), k)
    return counted(asked, True) + counted(_bounded(queries, near, k), False)
