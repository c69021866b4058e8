"""Best-fit packing by exact-complement hashing.

Documents become token ids with an end id, and ids over ``capacity`` are cut into pieces of that length (only the
first piece may be shorter). Pieces of full length are sequences of their own. For the others only the number of
pieces of each length matters, ``capacity`` numbers whatever the corpus, so the packing is planned from those counts:

* for the longest length left, the gap that it leaves is looked up among single lengths, then sums of two, then sums
  of three, under the counts that are still available, and the combination is used for as many sequences at once as
  the counts allow;
* where no combination fills a gap exactly, the longest length that fits is put in, and the smaller gap is looked up
  again; a gap that nothing fits stays.

A plan is a list of patterns (lengths, times). Pieces get a rank within their length, without any sort of all pieces
of one length: ranks are counted within (length, salt) and shifted by the counts of earlier salts. A pattern's share
of a length is a range of ranks, which gives each piece its sequence and place.

Defined results: a null or empty text is the end id alone; a document's pieces may lie in different sequences; a null
``doc_id`` is kept; rows given twice are packed twice; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwell.llm.common import checkpointed, sent_if_few, table

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k"
#: Pieces of one length are dealt into salts of about SALTED for ranking, at most MOST_SALTS of them.
SALTED, MOST_SALTS = 500, 4096
#: Counts (of 24 bytes each) up to which they are broadcast rather than joined by a shuffle.
SENT = 300_000


@lru_cache(maxsize=1)
def _whole(vocabulary: str):
    """The tokenizer itself, loaded where a text needs it: it takes much memory."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A function from a text to its ids in the public byte-level vocabulary of that name.

    The file of ranks holds the same vocabulary and splitting pattern as the tokenizer's own file and is several times
    faster. Only a text that holds one of the tokenizer's special strings goes through the tokenizer itself.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return _whole(vocabulary).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces; all but the first have full length."""
    first = len(ids) % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, len(ids), capacity))]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for frame in frames:
            rows = []
            for key, body in zip(frame["k"], frame["t"]):
                ids = np.array([*encode(body or ""), END], "<u4")
                rows += [(key, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(ids, capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(docs[doc_id].alias("k"), docs[text].alias("t")).mapInPandas(batches, "doc_id long, piece int, start long, length long, ids_crc32 long")


# The plan


def _exact(gap: int, have: np.ndarray, own: int) -> tuple[int, ...] | None:
    """One, two or three available lengths with the sum ``gap``, the longest first; ``own`` is one length in use."""
    left = have.copy()
    left[own] -= 1
    if left[gap] > 0:
        return (gap,)
    there = left[: gap + 1] > 0
    a = np.flatnonzero(there)
    a = a[a > 0]
    # a >= b, and two of the same length only where two are left
    partner = gap - a
    two = a[(partner > 0) & (partner <= a) & there[partner] & ((partner != a) | (left[a] > 1))]
    if len(two):
        return int(two[-1]), int(gap - two[-1])
    for x in a[::-1].tolist():
        if 3 * x < gap:
            break
        y = a[(a <= x) & (a <= gap - x)]
        z = gap - x - y
        good = (z > 0) & (z <= y) & there[np.maximum(z, 0)]
        need = (y == x).astype(int) + (z == x)  # further pieces of length x
        good &= (left[x] > need) & ((y != z) | (left[y] > 1 + (y == x)))
        if good.any():
            k = np.flatnonzero(good)[-1]
            return x, int(y[k]), int(z[k])
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use every piece once and hold at most ``capacity`` tokens each."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    done = []
    for own in range(capacity, 0, -1):
        while have[own] > 0:
            chosen, gap = [own], capacity - own
            while gap:
                left = have.copy()
                for x in chosen[1:]:
                    left[x] -= 1
                if combination := _exact(gap, left, own):
                    chosen += combination
                    break
                left[own] -= 1
                fits = np.flatnonzero(left[1 : gap + 1] > 0)
                if not len(fits):
                    break
                chosen.append(int(fits[-1]) + 1)
                gap -= chosen[-1]
            lengths, uses = np.unique(chosen, return_counts=True)
            times = int((have[lengths] // uses).min())
            have[lengths] -= uses * times
            done.append((tuple(chosen), times))
    return done


def shares(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): which ranks of a length go where."""
    out, ranks, sequence = [], {}, 0
    for chosen, times in patterns:
        offset = 0
        for length in chosen:
            first = ranks.get(length, 0)
            out.append((length, first, first + times, sequence, offset))
            ranks[length] = first + times
            offset += length
        sequence += times
    return out


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. Reads ``cut_up`` three times: give it written out."""
    spark = cut_up.sparkSession
    totals = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    parts = spark.createDataFrame([(length, min(MOST_SALTS, -(-n // SALTED))) for length, n in totals.items()] or [(0, 1)], "length long, salts int")
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cut_up.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(key, F.col("salts")).cast("int")).drop("salts")
    counts = dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # A length's running sum needs only its own salts.
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = checkpointed(counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    share = spark.createDataFrame(shares(plan(totals, capacity)) or [(0, 0, 0, 0, 0)], "length long, rank_from long, rank_to long, first_sequence long, offset long")
    ordered = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    within = dealt.withColumn("within", F.row_number().over(ordered) - 1)
    ranked = within.join(sent_if_few(before, SENT), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    # The shares are bounded by the plan: at most some thousand patterns of a few lengths.
    placed = ranked.join(F.broadcast(share), ["length"]).where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(checkpointed(pieces(docs, doc_id, text, capacity, vocabulary)), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
