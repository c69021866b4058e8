r"""Filter interaction audit: what each filter removes in every order of the filters.

A document fails a set of filters, a mask of five bits; in a given order it is removed at the first step whose filter
it fails. That step is looked up in a table of 32 masks by 120 orders which is made once. The filters are

* A: fewer than 100 words (maximal runs of ``[^\x20\x09-\x0D]``),
* B: distinct words under 80 % of the words,
* C: ``[A-Z]`` characters over 10 % of the code points,
* D: any of ``#$%&*|``,
* E: the text of a smaller doc_id, anywhere in the table and whether removed or not.

One pass over the whole texts gives A to D, a digest and the part (language) of each document; from there on texts no
longer travel. Rows are counted by (digest, part, mask, labels) with the smallest id, which map-side combination
starts, so a group of copies is a few rows however large it is; the smallest id of a digest then tells E. Tasks index
the table with the counted masks and add up removals by part, order and step for all, good and toxic documents
(``np.bincount``); their partial arrays are summed by part.

Defined results: a null text is empty; empty texts are equal to each other; a null language is the empty part, as an
empty one is; a null ``doc_id`` has no smaller one, is smaller than none and has no labels; rows given twice count
twice, neither has E by the other; labels given twice count as good or toxic if any row says so, null labels as 0; an
empty table gives an empty table; a text is read whole, a very long one in stretches cut at white space; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import checkpointed, table

FILTERS = "ABCDE"
#: Fixed values of the filters: fewest words, least percentage of distinct words, most percentage of capitals.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text whose words are taken at once, and parts that a task adds up before it passes their arrays on.
STRETCH, PARTS_AT_ONCE = 4 << 20, 256

FEATURES = "doc_id long, part string, digest binary, mask int"
PARTIAL = "part string, masks array<long>, removed array<long>, good array<long>, toxic array<long>"
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@lru_cache(maxsize=1)
def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


@lru_cache(maxsize=1)
def first_failure() -> np.ndarray:
    """For each mask and order the step (from 0) that removes, 5 where none does."""
    n = len(FILTERS)
    bits = np.array([[FILTERS.index(f) for f in order] for order in orders()])
    fails = np.arange(1 << n)[:, None, None] >> bits[None] & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), n)


def stretches(text: bytes) -> Iterator[bytes]:
    """A text in stretches of some ``STRETCH`` bytes that cut no word."""
    start = 0
    while len(text) - start > STRETCH:
        blank = BLANK.search(text, start + STRETCH)
        if blank is None:
            break
        yield text[start : blank.start()]
        start = blank.end()
    yield text[start:]


def text_mask(text: bytes) -> int:
    """The bits of A to D."""
    words, distinct = 0, set()
    for stretch in stretches(text):
        found = stretch.split()
        words += len(found)
        distinct.update(found)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = int(np.count_nonzero(np.frombuffer(text, np.int8) >= -64))
    return (words < FEWEST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT * words) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | bool(SIGNS.search(text)) << 3


def text_features(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(doc_id, part, digest, mask of A to D) of every row."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = batch.column(2).to_pylist()
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()), pa.array([text_mask(t) for t in texts], pa.int32())
            ], names=["doc_id", "part", "digest", "mask"])

    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("p"), body.alias("t"))
    return chosen.mapInArrow(batches, FEATURES)


def counted_masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask of A to E, good, toxic, n): a row for each digest and combination, E told."""
    said = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality"), said("toxic"))
    found = checkpointed(text_features(docs, doc_id, text, part))
    # Rows without an id have no labels: they stay out of the join, where they would all be one key.
    marked = found.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left").select("doc_id", "part", "digest", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = found.where(F.col("doc_id").isNull()).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # A row given twice has its id twice: counts by document first tell how many rows the smallest id has.
    groups = ["digest", "part", "mask", "good", "toxic"]
    counted = checkpointed(
        marked.groupBy("doc_id", *groups).agg(F.count(F.lit(1)).alias("n")).groupBy(*groups).agg(F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("firsts"), F.sum("n").alias("n"))
    )
    smallest = counted.groupBy("digest").agg(F.min("first").alias("smallest"))
    own = F.when(F.col("first") == F.col("smallest"), F.col("firsts")).otherwise(F.lit(0))
    told = counted.join(smallest, "digest").select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n")))).alias("x")
    )
    told = told.select("part", F.col("x.mask").alias("mask"), "good", "toxic", F.col("x.n").alias("n")).where("n > 0")
    return told.unionByName(nameless.select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n"))


class Removals:
    """Removals by part, order and step, added up batch by batch."""

    def __init__(self) -> None:
        self.parts: dict[str, np.ndarray] = {}

    def add(self, parts: list[str], masks: np.ndarray, weights: list[np.ndarray]) -> None:
        names, code = np.unique(np.array(parts, dtype=object), return_inverse=True)
        steps, n_orders = len(FILTERS) + 1, len(orders())
        cells = first_failure()[masks] + steps * np.arange(n_orders)
        for lo in range(0, len(names), PARTS_AT_ONCE):
            here = (code >= lo) & (code < lo + PARTS_AT_ONCE)
            k = min(PARTS_AT_ONCE, len(names) - lo)
            at = ((code[here] - lo)[:, None] * (steps * n_orders) + cells[here]).ravel()
            sums = [np.bincount(code[here] - lo + k * masks[here], weights[0][here], 32 * k).reshape(32, k).T]
            sums += [np.bincount(at, np.repeat(w[here], n_orders), k * steps * n_orders).reshape(k, -1) for w in weights]
            for i, row in enumerate(np.concatenate(sums, axis=1)):
                name = names[lo + i]
                self.parts[name] = self.parts.get(name, 0) + row

    def batch(self) -> pa.RecordBatch:
        cuts = np.cumsum([32, 720, 720])
        columns = list(zip(*([c.astype(np.int64) for c in np.split(row, cuts)] for row in self.parts.values())))
        names, self.parts = list(self.parts), {}
        return pa.record_batch([pa.array(names, pa.string()), *(pa.array(list(c), pa.list_(pa.int64())) for c in columns)], names=["part", "masks", "removed", "good", "toxic"])


def partial_arrays(counted: DataFrame) -> DataFrame:
    """One row for each task and part: counts of masks, and removals by order and step of all, good and toxic rows."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Removals()
        for batch in found:
            mask, good, toxic, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "good", "toxic", "n"))
            if len(n):
                sums.add(batch.column("part").to_pylist(), mask, [n, n * good, n * toxic])
            if len(sums.parts) > PARTS_AT_ONCE:
                yield sums.batch()
        if sums.parts:
            yield sums.batch()

    return counted.select("part", "mask", "good", "toxic", "n").mapInArrow(batches, PARTIAL)


def report(sums: DataFrame) -> DataFrame:
    """The 600 rows of each part from its summed arrays."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(FILTERS)
        letters = np.array([[FILTERS.index(f) for f in order] for order in orders()])
        names, steps = np.repeat(np.array(orders(), dtype=object), n), np.tile(np.arange(1, n + 1), len(orders()))
        for batch in found:
            for part, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.array(values, np.int64)
                masks, (removed, good, toxic) = values[:32], values[32:].reshape(3, len(orders()), n + 1)[:, :, :n]
                fails = np.array([masks[(np.arange(32) >> f & 1) == 1].sum() for f in range(n)])
                counts = {
                    "kept": masks.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": fails[letters] - removed, "unique_fails": masks[1 << letters], "good_lost": good, "toxic_lost": toxic,
                    "shapley": np.bincount(letters.ravel(), removed.ravel(), n).astype(np.int64)[letters],
                }
                columns = [pa.array([part] * len(names), pa.string()), pa.array(list(names), pa.string()), pa.array(steps, pa.int32()), *(pa.array(c.ravel(), pa.int64()) for c in counts.values())]
                yield pa.record_batch(columns, names=["part", "filter_order", "step", *counts])

    return sums.mapInArrow(batches, REPORT)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    partial = partial_arrays(counted_masks(docs, labels, doc_id, text, part))
    cells = partial.select("part", F.posexplode(F.concat("masks", "removed", "good", "toxic")).alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    # As many cells for each part as the arrays have, 32 and 3 x 720.
    return report(cells.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("sums")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = {
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
m AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             map {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
                  'D': regexp_matches(text, '[#$%&*|]'), 'E': e} AS f
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, good, toxic, f['A'] AS a, f['B'] AS b, f['C'] AS c, f['D'] AS d, f['E'] AS e, any_value(f) AS f, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(string_split('ABCDE', '')) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
p AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
c AS (SELECT g.part, p.filter_order, p.step, substr(p.filter_order, p.step, 1) AS x, g.n, good, toxic, f[substr(p.filter_order, p.step, 1)] AS fails,
             len(list_filter(string_split(substr(p.filter_order, 1, p.step - 1), ''), lambda y: f[y])) > 0 AS before,
             len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: f[y])) = 1 AS one
      FROM g, p),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, any_value(x) AS x,
             sum(CASE WHEN NOT before AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT before AND fails THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN before AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN one AND fails THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT before AND fails THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT before AND fails THEN n * toxic ELSE 0 END) AS toxic_lost
      FROM c GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
}
QUERIES = {"op11_filter_audit": op11_filter_audit}
