"""Benchmark decontamination by the q-gram lemma.

Texts are compared as letters and digits in lower case, runs of anything else being one space. A benchmark passage of
m such characters leaks into a document when some stretch of the document is within e = floor(``BUDGET`` * m) edits
of the whole passage. Passages of fewer than ``SHORT`` characters are compared with the spaces around them, so that
they are found between word limits.

* Lemma: such a stretch shares at least m + 1 - q - q*e character q-grams with the passage, all of them on e + 1
  neighbouring diagonals (place in the document minus place in the passage). q is 8, and 5 for the short passages,
  for which the bound then is above 0 as well.
* Diagonals are cut into cells of e + 1. Two neighbouring cells are a band, so bands overlap by half and every such
  window of diagonals lies within one band. Shared q-grams are counted by band; bands that meet the bound are kept,
  and those of one passage that touch are one region of the document. The others are dropped.
* Regions are verified by banded alignment: edit distances over their diagonals only, with free ends in the document,
  all regions of a passage side by side. A region is left as soon as it exceeds the budget, and none is aligned where
  the passage stands unchanged.

Passages that allow no edit (of up to 12 characters) need no alignment: a document's stretches of as many words are
looked up in a table.

The passages' q-grams are the query set. They are sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters
(one pass over the documents for each), so what is broadcast has a fixed bound. Documents are not shuffled, and a
task works on ``CHUNK_CHARS`` characters of a document and ``PAIRS`` shared q-grams at once, however long it is.

Defined results: a null or empty text or passage leaks nowhere; each passage is looked for in each document whole, however long; passages given twice
and documents given twice give their rows twice; a null id is kept; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import checkpointed, table

#: Length of the grams, edits for each character of a passage, and length below which passages are short.
Q, BUDGET, SHORT = 8, 0.08, 40
#: Length of the grams of short passages.
Q_SHORT = 5
#: Characters of passages in a block; characters of a document, shared q-grams and diagonals that are worked on at once.
BLOCK_CHARS, CHUNK_CHARS, PAIRS, DIAGONALS = 4_000_000, 1_000_000, 4_000_000, 1 << 18
_OTHER = re.compile(r"[\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: log2 of the size of the table by which most places are ruled out.
SIEVE = 22

SCHEMA = "item_id long, edits int, start long, end long, item_chars long"


def normalised(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams, by place: blocks of doubling length are combined, so few passes do."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    n, done, size = len(chars) - q + 1, None, 1
    power, h, left = q, (chars.astype(np.uint64) + np.uint64(1)) * _MIX, 0
    while power:
        if power & 1:
            part = h[left : left + n]
            done = part.copy() if done is None else (done ^ (done >> np.uint64(29))) * _MIX + part
            left += size
        power >>= 1
        if power:
            h = (h[:-size] ^ (h[:-size] >> np.uint64(31))) * _MIX + h[size:]
            size *= 2
    return done ^ (done >> np.uint64(32))


def edits_allowed(m: int) -> int:
    return int(BUDGET * m + 1e-9)


class Index:
    """The q-grams of some passages, (number, characters, edits allowed) each."""

    def __init__(self, passages: list[tuple[int, str, int]], q: int):
        self.passages, self.q = passages, q
        found = [grams(codes(t), q) for _, t, _ in passages]
        of = np.repeat(np.arange(len(found)), [len(g) for g in found])
        place = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        all_grams = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(all_grams, kind="stable")
        self.grams, first = np.unique(all_grams[order], return_index=True)
        self.first = np.append(first, len(order))
        self.of, self.place = of[order], place[order]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.grams & np.uint64((1 << SIEVE) - 1)] = True
        self.width = np.array([e + 1 for _, _, e in passages], np.int64)
        self.least = np.array([len(t) + 1 - q - q * e for _, t, e in passages], np.int64)

    def counted(self, chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(cell keys, shared q-grams) of a document, a part at a time. A key is a passage's number and a cell."""
        for begin in range(0, len(chars) - self.q + 1, CHUNK_CHARS):
            g = grams(chars[begin : begin + CHUNK_CHARS + self.q - 1], self.q)
            maybe = np.flatnonzero(self.sieve[g & np.uint64((1 << SIEVE) - 1)])
            at = np.searchsorted(self.grams, g[maybe])
            at[at == len(self.grams)] = 0
            good = self.grams[at] == g[maybe]
            maybe, at = maybe[good], at[good]
            n = self.first[at + 1] - self.first[at]
            if not len(n):
                continue
            # Every (place in the text, place in a passage) with the same gram.
            total = np.cumsum(n)
            limits = np.unique([0, *np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)), len(n)])
            for low, high in zip(limits[:-1], limits[1:]):
                m = n[low:high]
                entry = np.repeat(self.first[at[low:high]] - (total[low:high] - m - (total[low] - n[low])), m) + np.arange(m.sum())
                item = self.of[entry]
                cell = (begin + np.repeat(maybe[low:high], m) - self.place[entry]) // self.width[item]
                yield np.unique(item * (1 << 40) + cell + (1 << 30), return_counts=True)  # cells before the text's begin are negative

    def regions(self, chars: np.ndarray) -> dict[int, list[list[int]]]:
        """By passage, [first diagonal, end] of the regions where the bound is met."""
        parts = list(self.counted(chars)) if len(self.grams) else []
        if not parts:
            return {}
        cells, count = parts[0]
        if len(parts) > 1:
            cells, of = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            count = np.bincount(of, np.concatenate([n for _, n in parts])).astype(np.int64)
        if 2 * count.max() < self.least.min():
            return {}
        # A band is a cell and the next one; a cell without hits before one with hits starts a band as well.
        starts = np.unique(np.concatenate((cells, cells - 1)))

        def hits(k):
            i = np.minimum(np.searchsorted(cells, k), len(cells) - 1)
            return np.where(cells[i] == k, count[i], 0)

        met = starts[hits(starts) + hits(starts + 1) >= self.least[starts >> 40]]
        found: dict[int, list[list[int]]] = {}
        for key in met.tolist():
            k, cell, width = key >> 40, (key & ((1 << 40) - 1)) - (1 << 30), int(self.width[key >> 40])
            mine = found.setdefault(k, [])
            if mine and cell * width <= mine[-1][1]:
                mine[-1][1] = (cell + 2) * width
            else:
                mine.append([cell * width, (cell + 2) * width])
        return found

    def found(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(number, edits, start, end) of each passage's best stretch in ``text``."""
        chars = codes(text)
        for k, regions in self.regions(chars).items():
            number, passage, most = self.passages[k]
            at = text.find(passage)
            best = (0, at, at + len(passage)) if at >= 0 else aligned(codes(passage), chars, regions, most)
            if best is not None:
                yield number, *best


class Block:
    """Some passages, by how they are found."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = items
        edits = [edits_allowed(len(t)) for _, t in items]
        self.long = Index([(i, t, e) for i, ((_, t), e) in enumerate(zip(items, edits)) if len(t) >= SHORT], Q)
        self.short = Index([(i, f" {t} ", e) for i, ((_, t), e) in enumerate(zip(items, edits)) if e and len(t) < SHORT], Q_SHORT)
        # Passages without edits by their words; by a first word, the numbers of words that passages with it have.
        self.whole: dict[str, list[int]] = {}
        self.lengths: dict[str, set[int]] = {}
        for i, (_, t) in enumerate(items):
            if t and not edits[i]:
                words = t.split(" ")
                self.whole.setdefault(t, []).append(i)
                self.lengths.setdefault(words[0], set()).add(len(words))

    def stretches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(number, edits, start, end) of each passage's best stretch in ``text``."""
        yield from self.long.found(text)
        if self.short.passages:
            for i, edits, start, end in self.short.found(f" {text} "):
                # From places in the text with spaces around, the passage's own left out.
                yield i, edits, min(start, len(text)), max(min(start, len(text)), min(end - 2, len(text)))
        if self.whole:
            yield from self.unchanged(text)

    def unchanged(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """The first place of each passage of ``whole`` that stands in ``text`` between word limits."""
        start, first = 0, {}
        words = text.split(" ")
        for at, word in enumerate(words):
            for n in self.lengths.get(word, ()):
                passage = " ".join(words[at : at + n])
                if passage in self.whole:
                    first.setdefault(passage, start)
            start += len(word) + 1
        for passage, start in first.items():
            for i in self.whole[passage]:
                yield i, 0, start, start + len(passage)

    def found(self, text: str) -> list[tuple]:
        """Rows of SCHEMA."""
        return [(self.items[i][0], *best, len(self.items[i][1])) for i, *best in sorted(self.stretches(text))]

    def holds_any(self, text: str) -> bool:
        return next(self.stretches(text), None) is not None


def _pieces(regions: list[list[int]], overlap: int) -> Iterator[list[list[int]]]:
    """The regions in lots of at most some DIAGONALS; wide ones in pieces that overlap by a band."""
    lot, size = [], 0
    for low, high in regions:
        while low < high:
            end = min(high, low + DIAGONALS)
            if lot and size + end - low > DIAGONALS:
                yield lot
                lot, size = [], 0
            lot.append([low, end])
            size += end - low
            low = end if end == high else end - overlap
    if lot:
        yield lot


def aligned(passage: np.ndarray, text: np.ndarray, regions: list[list[int]], most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best stretch of ``text`` on the regions' diagonals, or None above ``most`` edits."""
    best = None
    for lot in _pieces(regions, 2 * (most + 1)):
        got = _aligned(passage, text, lot, most)
        if got is not None and (best is None or got < best):
            best = got
    return best


def _aligned(passage: np.ndarray, text: np.ndarray, regions: list[list[int]], most: int) -> tuple[int, int, int] | None:
    """Row i holds the distances of the passage's first i characters to stretches that end at diagonal + i, and where
    each such stretch starts. The regions' diagonals lie one after the other in one array; a large number for each
    region before keeps what a running minimum sees of it out of the next one."""
    n, far, apart = len(text), 1 << 20, 1 << 22
    base = np.concatenate([np.arange(low, high) for low, high in regions])
    region = np.repeat(np.arange(len(regions)), [high - low for low, high in regions])
    before, after = max(0, -int(base.min())), max(0, int(base.max()) + len(passage) - n)
    window = np.full(before + n + after + 1, 0xFFFFFFFF, np.uint32)
    window[before : before + n] = text
    row, start, at = np.where((base >= 0) & (base <= n), 0, far), base, base + before
    last = np.append(region[1:] != region[:-1], True)
    level, place = region * apart + np.arange(len(base)), np.arange(len(base))
    for i, c in enumerate(passage, 1):
        # From the same diagonal: a match or substitution; from the next one: a character of the passage left out.
        same = row + (window[at + (i - 1)] != c)
        skip = np.append(row[1:], far) + 1
        skip[last] = far
        better = skip < same
        row, start = np.where(better, skip, same), np.where(better, np.append(start[1:], 0), start)
        if before or after:
            end = base + i
            row = np.where((end >= 0) & (end <= n), row, far)
        # Characters of the text left out: the least of row[k] + (j - k) over k <= j in the region.
        reduced = row - level
        least = np.minimum.accumulate(reduced)
        row, start = least + level, start[np.maximum.accumulate(np.where(reduced == least, place, 0))]
        if i % 8 == 0 or i == len(passage):
            first = np.flatnonzero(np.append(True, last[:-1]))
            alive = np.minimum.reduceat(row, first) <= most
            if not alive.any():
                return None
            if not alive.all():
                keep = np.repeat(alive, np.diff(np.append(first, len(row))))
                row, start, base, at, last, level = row[keep], start[keep], base[keep], at[keep], last[keep], level[keep]
                place = np.arange(len(row))
    j = np.lexsort((base, start, row))[0]
    return int(row[j]), int(start[j]), int(base[j] + len(passage))


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """The passages, normalised, in blocks of bounded size; one block at a time is on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        passage = normalised(row["t"])
        if passage:
            if block and size + len(passage) > BLOCK_CHARS:
                yield block
                block, size = [], 0
            block.append((row["i"], passage))
            size += len(passage)
    if block:
        yield block


_INDEX: dict = {}


def _index_of(sent) -> Block:
    """The block's index, made once in each worker."""
    if sent.value[0] not in _INDEX:
        _INDEX.clear()
        _INDEX[sent.value[0]] = Block(sent.value[1])
    return _INDEX[sent.value[0]]


def _sent(docs: DataFrame, items: list):
    import uuid

    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, end, item_chars): passages found in documents, places in the normalised text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(docs[doc_id].alias("k"), docs[text].alias("t"))
    schema, out = f"doc_id {kind}, {SCHEMA}", None
    for items in blocks(benchmark, item_id, item_text):

        def batches(frames: Iterator[pd.DataFrame], sent=_sent(docs, items)) -> Iterator[pd.DataFrame]:
            index = _index_of(sent)
            for frame in frames:
                rows = [(key, *x) for key, t in zip(frame["k"], frame["t"]) for x in index.found(normalised(t))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = given.mapInPandas(batches, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no passage is found, all columns as they were.

    What a block leaves is written out before the next one, so a worker holds one block's index at a time.
    """
    for n, items in enumerate(blocks(benchmark, item_id, item_text)):
        docs = (checkpointed(docs) if n else docs).where(_is_clean(_sent(docs, items))(F.col(text)))
    return docs


def _is_clean(sent):
    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index_of(sent)
        for part in parts:
            yield pd.Series([not index.holds_any(normalised(t)) for t in part], dtype=bool)

    return clean


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage found in every document, with its edits and place."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_benchmark_leaks": op3_benchmark_leaks}
