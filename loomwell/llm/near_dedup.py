"""MinHash near-duplicate groups with sequential Bayesian verification.

A document is the set of its distinct shingles of ``WORDS`` words. Two documents are linked when the Jaccard
similarity of their sets is at least ``THRESHOLD`` per cent; groups are the connected components.

1. Equal sets are one class, named by the smallest document id; only classes go on.
2. A class gives ``BANDS`` bands of ``ROWS`` minima each. Classes that share a band are candidates. A pair at the
   threshold is missed by all bands with a probability of 3e-7.
3. Inside a bucket all members are compared with its smallest one. A link puts both into one group, so members that
   meet in one group need no comparison. What is left, pairs of members in different groups, is taken up in two
   ways: buckets of up to ``SMALL`` members give those pairs; members of larger ones are grouped anew by the rarest
   shingles of their sets, of which linked pairs share at least one, and compared where sizes and places of that
   shingle leave a link possible, in large buckets with some members at a time, until no pair in different groups is
   left. No pair is ever given up.
4. A pair is verified sequentially: signatures are compared in batches, and after each batch the pair is dropped if
   its posterior probability to reach the threshold (uniform prior) is under ``MISS``. Survivors are confirmed
   exactly on the full sets.

Joins are plain equi-joins that Spark can split where a key is hot, and every count is combined before the shuffle.

Defined results: null, empty and white-space texts have no shingles and are linked with nothing; a text with fewer
than ``WORDS`` words has its whole word sequence as one shingle; a row with a null ``doc_id`` is linked with nothing
and kept; rows given twice have equal results (an id names one document); an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import checkpointed, sent_if_few, table

WORDS, THRESHOLD = 5, 80
BANDS, ROWS = 32, 6
#: Signature values compared at once, and the probability with which a pair at the threshold may be dropped early.
BATCH, MISS = 32, 1e-7
#: Members up to which a bucket of a band, and one of a rare shingle, gives its pairs directly; members that a larger
#: one of the latter compares at first, and later.
SMALL, SMALL_RARE, AT_FIRST, AT_A_TIME = 16, 16, 16, 256
#: log2 of the most hash cells by which shingles of common passages are told from others.
CELLS = 22
#: Classes (of 24 bytes each) up to which a list is broadcast to the documents rather than joined by a shuffle.
SENT = 300_000
#: Shingles hashed at once: 192 signature values for each stay within the processor's cache.
BLOCK = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and increments of the signature's hash functions on 32-bit numbers."""
    rng = np.random.default_rng(20)
    return (rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]


class Hasher:
    """Shingle hashes of texts; words are hashed once each, up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        if len(self.known) > 100_000:
            self.known.clear()
        known, words = self.known, (text or "").encode("utf-8", "surrogatepass").lower().split()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            known.update((w, xxh3_64_intdigest(w)) for w in set(words) if w not in known)
            return np.array([known[w] for w in words], np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct 64-bit hashes of the text's shingles."""
        w = self.words(text)
        if not len(w):
            return w
        size = min(WORDS, len(w))
        h = np.full(len(w) - size + 1, size, np.uint64)
        for k in range(size):
            h = (h ^ w[k : len(w) - size + 1 + k]) * _MIX
            h ^= h >> np.uint64(29)
        return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value of each hash function over a set."""
    a, b = _family()
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = None
    for k in range(0, len(low), BLOCK):
        x = low[None, k : k + BLOCK] * a
        x += b
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        least = x.min(axis=1)
        best = least if best is None else np.minimum(best, least)
    return (best * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, digest of the set, signature) of every document; no digest for an empty set."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for frame in frames:
            rows = []
            for key, body in zip(frame["k"], frame["t"]):
                s = hasher.shingles(body)
                rows.append((key, len(s), hashlib.md5(s.tobytes()).digest() if len(s) else None, signature(s).tobytes() if len(s) else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "digest", "sig"]).astype({"doc_id": "Int64"})

    return docs.select(docs[doc_id].alias("k"), docs[text].alias("t")).mapInPandas(batches, f"doc_id {kind}, n long, digest binary, sig binary")


# Verification


@lru_cache(maxsize=8)
def least_matches(threshold: int, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches with which a pair goes on) after each batch.

    With a uniform prior the posterior after m of n matches is Beta(m+1, n-m+1), and its share above t is the
    probability of at most m successes in n+1 trials of probability t.
    """
    t, out = threshold / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        share, m = (1 - t) ** (n + 1), 0
        while share < miss:
            m += 1
            share += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def _plausible(threshold: int):
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = least_matches(threshold)
        for frame in frames:
            if not len(frame):
                continue
            one, two = (np.frombuffer(b"".join(frame[c]), np.uint16).reshape(len(frame), -1) for c in ("sig_a", "sig_b"))
            alive, matches, done = np.arange(len(frame)), np.zeros(len(frame), int), 0
            for n, least in steps:
                matches = matches + (one[alive, done:n] == two[alive, done:n]).sum(axis=1)
                stay = matches >= least
                alive, matches, done = alive[stay], matches[stay], n
            yield frame.iloc[alive][["a", "b"]]

    return batches


def _linked(threshold: int):
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(frame["of_a"], frame["of_b"])], np.int64)
            sizes = frame["of_a"].str.len().to_numpy(np.int64) + frame["of_b"].str.len().to_numpy(np.int64)
            yield frame[100 * common >= threshold * (sizes - common)][["a", "b"]]

    return batches


def _sets_of(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(v, shingles) of the classes in ``wanted`` (v, digest), from their texts; twice for a row given twice."""
    kind = wanted.schema["v"].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("v"), docs[text].alias("t")).join(sent_if_few(wanted, SENT), "v")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for frame in frames:
            found, size = [], 0
            for v, t, digest in zip(frame["v"], frame["t"], frame["digest"]):
                s = hasher.shingles(t)
                if hashlib.md5(s.tobytes()).digest() == digest:
                    found.append((v, s.view(np.int64)))
                    size += len(s)
                if size > 500_000:
                    yield pd.DataFrame(found, columns=["v", "shingles"])
                    found, size = [], 0
            if found:
                yield pd.DataFrame(found, columns=["v", "shingles"])

    return rows.mapInPandas(batches, f"v {kind}, shingles array<bigint>")


class _Groups:
    """The classes of one corpus, and the group that each linked class is in so far (``labels``: v, label)."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, threshold: int):
        self.docs, self.doc_id, self.text, self.threshold = docs, doc_id, text, threshold
        found = checkpointed(sets(docs, doc_id, text))
        self.rows = found.select("doc_id", "n", "digest")
        of_a_set = found.where("digest is not null and doc_id is not null")
        self.classes = checkpointed(of_a_set.groupBy("digest").agg(F.min("doc_id").alias("v"), F.first("sig").alias("sig"), F.first("n").alias("n")))
        self.labels = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that their signatures don't rule out."""
        of = lambda c: self.near.select(F.col("v").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
        # No similarity exceeds the quotient of the sizes.
        both = pairs.join(of("b"), "b").join(of("a"), "a").where(100 * F.least("n_a", "n_b") >= self.threshold * F.greatest("n_a", "n_b"))
        kind = pairs.schema["a"].dataType.simpleString()
        return both.select("a", "b", "sig_a", "sig_b").mapInPandas(_plausible(self.threshold), f"a {kind}, b {kind}")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold."""
        kind = pairs.schema["a"].dataType.simpleString()
        full = lambda c: self.full.select(F.col("v").alias(c), F.col("shingles").alias(f"of_{c}"))
        held = pairs.join(full("b"), "b").join(full("a"), "a").select("a", "b", "of_a", "of_b")
        return checkpointed(held.mapInPandas(_linked(self.threshold), f"a {kind}, b {kind}"))

    def add(self, pairs: DataFrame, banded: bool = True) -> None:
        """Verify pairs and merge the groups that they link.

        Pairs that only bands have brought together go through their signatures first. Those that come by rare
        shingles are near the threshold, where signatures would let nearly all of them pass.
        """
        new = self.linked(self.likely(pairs) if banded else pairs)
        if self.labels is not None:
            group = lambda c: self.labels.select(F.col("v").alias(c), F.col("label").alias(f"of_{c}"))
            named = new.join(group("a"), "a", "left").join(group("b"), "b", "left")
            new = checkpointed(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct())
        if new.isEmpty():
            return
        merged = components(new)
        if self.labels is None:
            self.labels = merged
            return
        # Groups of one that are linked for the first time come in as their own label.
        every = self.labels.unionByName(merged.select("v", F.col("v").alias("label"))).groupBy("v").agg(F.min("label").alias("label"))
        renamed = every.join(merged.select(F.col("v").alias("label"), F.col("label").alias("now")), "label", "left")
        self.labels = checkpointed(renamed.select("v", F.coalesce("now", "label").alias("label")))

    def grouped(self, members: DataFrame) -> DataFrame:
        """``members`` (bucket, v, ...) with the group g of each."""
        if self.labels is None:
            return members.withColumn("g", F.col("v"))
        return members.join(self.labels, "v", "left").select(*(members[c] for c in members.columns), F.coalesce("label", members["v"]).alias("g"))

    def mixed(self, members: DataFrame) -> DataFrame | None:
        """``members`` with group g and the bucket's size m, of the buckets with several groups; None without any."""
        grouped = self.grouped(members)
        several = grouped.groupBy("bucket").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high")
        left = checkpointed(grouped.join(several.select("bucket", "m"), "bucket"))
        return None if left.isEmpty() else left

    def compare_with_least(self, members: DataFrame) -> DataFrame | None:
        """Compare the members of each bucket with its smallest one; the others that then are in several groups."""
        least = checkpointed(members.groupBy("bucket").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a < z").select("bucket", "a"))
        self.add(members.join(least, "bucket").where("v > a").select("a", F.col("v").alias("b")).distinct())
        return self.mixed(members.join(least, "bucket").where("v > a").drop("a"))

    def compare_all(self, members: DataFrame, leads: DataFrame, possible: Column, banded: bool) -> None:
        """Every member with every lead of its bucket that is in another group, where ``possible`` does not rule it out."""
        other = leads.select("bucket", *(F.col(c).alias(f"{c}2") for c in leads.columns if c != "bucket"))
        wanted = (members["bucket"] == other["bucket"]) & (F.col("g") != F.col("g2"))
        pairs = members.join(other, wanted & possible).select(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b")).distinct()
        self.add(pairs, banded)

    def by_rare_shingles(self, members: DataFrame) -> DataFrame:
        """(bucket, v, size, reach): the members regrouped by shingles of which linked sets share at least one.

        In a common order, two sets at the threshold share one of the first size - ceil(size * threshold) + 1. In the
        bucket of the first one that they share, what they have in common is at most the smaller of their reaches,
        the shingles from that one on. Any order gives all links; this one, by how many shingles of these members
        fall into the same hash cell, puts those of common passages last. There are some four cells a shingle, and at
        most 2 ** CELLS cells; what a task sees once in a cell is left out of the counts.
        """
        mine = checkpointed(members.select("v").distinct().join(self.full, "v"))
        total = mine.agg(F.sum(F.size("shingles")).alias("n")).first()["n"] or 0
        mask = (1 << min(CELLS, max(10, (4 * total).bit_length()))) - 1
        kind, threshold = mine.schema["v"].dataType.simpleString(), self.threshold

        def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = np.zeros(mask + 1, np.int32)
            for frame in frames:
                for s in frame["shingles"]:
                    np.add.at(n, s & mask, 1)
            cell = np.flatnonzero(n > 1)
            yield pd.DataFrame({"cell": cell, "n": n[cell]})

        counts = mine.select("shingles").mapInPandas(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        common = np.zeros(mask + 1, np.int32)
        common[counts["cell"].to_numpy(np.int64)] = np.minimum(counts["n"].to_numpy(np.int64), 1 << 30)
        sent = mine.sparkSession.sparkContext.broadcast(common)

        def first_ones(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                taken = [len(s) - (len(s) * threshold + 99) // 100 + 1 for s in frame["shingles"]]
                buckets = [s[np.lexsort((s, sent.value[s & mask]))[:n]] for s, n in zip(frame["shingles"], taken)]
                size = np.repeat(frame["shingles"].str.len().to_numpy(np.int64), taken)
                before = np.concatenate([np.arange(n) for n in taken])
                yield pd.DataFrame({"bucket": np.concatenate(buckets), "v": frame["v"].repeat(taken).to_numpy(), "size": size, "reach": size - before})

        placed = checkpointed(mine.mapInPandas(first_ones, f"bucket long, v {kind}, size int, reach int").distinct())
        # A member without any partner in its bucket goes: not even the smallest set there that is large enough would do.
        least = placed.groupBy("bucket").agg(F.min("size").alias("least"))
        partner = F.greatest("least", F.expr(f"int((size * {self.threshold} + 99) div 100)"))
        return placed.join(least, "bucket").where(self.enough(F.col("reach"), F.col("size") + partner)).drop("least")

    def enough(self, common: Column, sizes: Column) -> Column:
        """Whether ``common`` shingles of two sets of ``sizes`` in all reach the threshold."""
        return (100 + self.threshold) * common >= self.threshold * sizes

    def compare_by_rare_shingles(self, members: DataFrame) -> None:
        """All pairs of ``members`` that can be linked and are in different groups.

        Buckets of up to SMALL_RARE members at once, of larger ones some members against all others at a time. They are
        few at first, as a link that is found early spares the comparisons within its group.
        """
        possible = self.enough(F.least("reach", "reach2"), F.col("size") + F.col("size2"))
        left = self.mixed(self.by_rare_shingles(members))
        turns = 0
        while left is not None:
            at_a_time, turns = AT_A_TIME if turns else AT_FIRST, turns + 1
            small, large = left.where(F.col("m") <= SMALL_RARE), left.where(F.col("m") > SMALL_RARE)
            chosen = F.pmod(F.xxhash64("v"), F.col("m")) < at_a_time
            # Members are chosen by their hash, the same in every bucket of the same size; the smallest one always is, so the turns come to an end.
            turn = checkpointed(large.join(large.groupBy("bucket").agg(F.min("v").alias("first")), "bucket").withColumn("lead", chosen | (F.col("v") == F.col("first"))).drop("first"))
            leads = small.unionByName(turn.where("lead").drop("lead"))
            self.compare_all(small.unionByName(turn.drop("lead")), leads, (F.col("v") != F.col("v2")) & possible, False)
            rest = turn.where("not lead").drop("lead", "g", "m")
            left = self.mixed(rest)

    def run(self) -> None:
        banded = self.classes.select("v", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, _slice("sig", k)))).alias("band", "bucket")).select("bucket", "v")
        shared = banded.groupBy("bucket").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a < z").select("bucket")
        members = checkpointed(banded.join(shared, "bucket"))
        # Only classes that share a band are looked at again; their texts are read once for all comparisons.
        self.near = checkpointed(members.select("v").distinct().join(self.classes, "v"))
        self.full = checkpointed(_sets_of(self.docs, self.doc_id, self.text, self.near.select("v", "digest")))
        left = self.compare_with_least(members)
        if left is None:
            return
        small = left.where(F.col("m") <= SMALL)
        self.compare_all(small, small, F.col("v") < F.col("v2"), True)
        again = self.mixed(left.where(F.col("m") > SMALL).select("bucket", "v"))
        if again is not None:
            self.compare_by_rare_shingles(again)


def _slice(sig: str, k: Column) -> Column:
    return F.substring(F.col(sig), k * (2 * ROWS) + 1, F.lit(2 * ROWS))


def components(links: DataFrame) -> DataFrame:
    """(v, label): the smallest class of each linked class's component.

    Labels pass along links, and then each class takes its label's label, so that long chains shrink by half.
    """
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = checkpointed(labels.join(near, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        jump = lower.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = checkpointed(lower.join(jump, "label").select("v", F.least("label", "far").alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    groups = _Groups(docs, doc_id, text, threshold)
    groups.run()
    named = groups.classes.select("digest", "v")
    named = named.withColumn("label", F.col("v")) if groups.labels is None else named.join(groups.labels, "v", "left").select("digest", F.coalesce("label", "v").alias("label"))
    # Rows without a class get none: their join key is null.
    key = F.when(F.col("doc_id").isNotNull(), F.col("digest"))
    labelled = groups.rows.select("doc_id", "n", key.alias("digest")).join(named.select("digest", "label"), "digest", "left")
    component = F.coalesce("label", "doc_id")
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at a similarity of 0.85."""
    return near_groups(table(spark, sf_dir, "documents"), threshold=85)


QUERIES = {"op9_near_dedup": op9_near_dedup}
