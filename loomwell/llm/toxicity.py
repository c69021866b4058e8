"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window is a word with its spaces
around it; it is compressed with each, and the difference of the two lengths tells how much better toxic text explains
it. A document is described by how many of its windows reach each of a few differences, in number and per word;
weights on these are the calibration, and 0.5 is the threshold.

Nothing is chosen on held-out rows: the sample is parted into ``FOLDS`` by id, each fold is described by dictionaries of
the others, in each of the sizes ``SIZES``; the smallest size whose log loss over all folds is the least one, up to its deviation,
is taken, and the weights are fitted on these descriptions, so they see every document as one that its dictionaries never saw. Spark fits the folds and
the final dictionaries side by side, a task each; the driver gets descriptions and dictionaries, no texts.

How the dictionaries are made, from a bounded sample of labelled rows (``SAMPLE_ROWS`` a class, with whole texts; the
rows are those with the smallest hashes of their ids, and of rows with one id the first text counts):

* labels are given to documents, but toxicity sits in a few windows. The toxic side is trained on the words of toxic
  documents that hold a telling piece: one of ``GRAMS`` bytes found in more than ``RATIO`` times as many stretches of
  ``STRETCH`` words as ordinary documents let expect, by ``SURE`` standard deviations, and in several documents;
* the ordinary side is trained on stretches of ordinary text; then the ordinary words that hold no telling piece but
  are still explained better by the toxic side take up half of it, the most frequent ones at its end, nearest to the
  window. That is done ``ROUNDS`` times.

Both sides are used as plain content of the same size, with the same padding at the end, so that for a window in
neither the lengths agree. Labels, language, source and id are never part of a score.

Defined results: a null or empty text has no windows and gets the score of a document without findings; a null
``doc_id`` is kept and counts as held out; rows given twice come out twice; a null label is no label; without labels of both kinds
(an empty table too, which gives an empty table) every score is 0; extra columns are ignored. Every window of a text
counts, however long it is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import checkpointed, table

#: Bound of the sample that the model is fitted on: rows a class.
SAMPLE_ROWS = 1200
#: Pieces by which toxic words are told: their bytes, words of a stretch, how much more often than in ordinary text,
#: standard deviations above it, and the least number of documents.
GRAMS, STRETCH, RATIO, SURE, LEAST_DOCUMENTS = (5, 6, 7, 8), 30, 4, 10, 3
ROUNDS = 3
#: Parts of the sample for cross-validation, and sizes of a dictionary that are tried.
FOLDS, SIZES = 3, (6000, 9000, 13_000)
#: Ordinary documents whose pieces are counted at once.
LOT = 100
#: Differences in bytes whose frequency describes a document.
STEPS = (2, 3, 4, 5, 6, 8)
#: Ends every window and both dictionaries: the compressor looks for no match in the last 8 bytes of its input.
PADDING = bytes([1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19])
FITTED = "fold int, size int, toxic_side binary, ordinary_side binary, doc_id long, toxic boolean, x array<double>"
#: Words whose difference a worker keeps.
KEPT_WORDS = 150_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def _window(word: bytes) -> bytes:
    return b" " + word + b" "


def _compressor(content: bytes):
    import zstandard as z

    settings = z.ZstdCompressionParameters(
        window_log=17, chain_log=14, hash_log=14, search_log=5, min_match=4, target_length=16, strategy=z.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary = z.ZstdCompressionDict(content + PADDING, dict_type=z.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return z.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def _trained(samples: list[bytes], size: int) -> bytes:
    """``size`` bytes of a dictionary trained on ``samples``, or of the samples themselves where they are too few to train."""
    import zstandard as z

    try:
        raw = z.train_dictionary(size + 500, samples, k=16, d=6).as_bytes()
    except z.ZstdError:
        raw = b"".join(samples)
    return raw[-size:].rjust(size, b"\0")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    _kept: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.weights = state
        self._kept = {}

    def difference(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves on a window over the ordinary one."""
        found = self._kept.get(word)
        if found is None:
            if not hasattr(self, "_pair"):
                self._pair = _compressor(self.ordinary).compress, _compressor(self.toxic).compress
            window = _window(word) + PADDING
            found = len(self._pair[0](window)) - len(self._pair[1](window))
            if len(self._kept) < KEPT_WORDS:
                self._kept[word] = found
        return found

    def described(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        found = Counter(map(self.difference, words))
        reach = np.array([sum(n for d, n in found.items() if d >= step) for step in STEPS], float)
        return np.concatenate(([1.0], np.log1p(reach), np.sqrt(reach / (len(words) + 20.0)), [np.log1p(len(words))]))

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.described(text) @ self.weights, -30, 30))))


@dataclass
class _Windows:
    """The windows of some documents in one buffer: a space, each word, a space."""

    text: np.ndarray
    word: np.ndarray
    stretch: np.ndarray
    document: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        """The place of each word, and one behind the last word's space."""
        return np.flatnonzero(self.text == 32) + 1

    @classmethod
    def of(cls, documents: list[list[bytes]]) -> "_Windows":
        text = np.frombuffer(b" " + b" ".join(w for words in documents for w in words) + b" ", np.uint8)
        sizes = np.array([len(words) for words in documents], np.int64)
        document = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(document)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.concatenate(([0], np.cumsum(-(-sizes // STRETCH))))
        return cls(text, np.cumsum(text == 32, dtype=np.int32) - 1, first[document] + place // STRETCH, document)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All pieces of ``n`` bytes of windows, as numbers, and the word of each. Only their ends may be spaces."""
        space = np.concatenate(([0], np.cumsum(self.text == 32, dtype=np.int32)))
        at = np.arange(max(0, len(self.text) - n + 1), dtype=np.int32)
        at = at[space[at + n - 1] == space[at + 1]]
        value = np.zeros(len(at), np.uint64)
        for k in range(n):
            value = value << np.uint64(8) | self.text[at + k]
        return value, self.word[at]


def _found_in(values: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """In how many places each of the values 0..n-1 is found."""
    return np.bincount(np.unique(places * n + values) % n, minlength=n)


def telling_words(bad: list[list[bytes]], good: list[list[bytes]]) -> tuple[np.ndarray, set[bytes]]:
    """Which words of toxic documents hold a telling piece, by place, and the ordinary ones that do."""
    toxic, lots = _Windows.of(bad), [_Windows.of(good[k : k + LOT]) for k in range(0, len(good), LOT)]
    marked, known_words = np.zeros(len(toxic.document), bool), set()
    lots = [lot for lot in lots if len(lot.document)]
    if not len(marked) or not lots:
        return marked, known_words
    share = (toxic.stretch[-1] + 1) / sum(int(lot.stretch[-1]) + 1 for lot in lots)
    for n in GRAMS:
        of_bad, word = toxic.grams(n)
        known, value = np.unique(of_bad, return_inverse=True)
        if not len(known):
            continue
        found, ordinary = _found_in(value, toxic.stretch[word], len(known)), np.zeros(len(known), np.int64)
        for lot in lots:
            at, of = _known(lot, n, known)
            ordinary += _found_in(at, lot.stretch[of], len(known))
        expected, least = (ordinary + 0.5) * share, max(LEAST_DOCUMENTS, len(bad) // 120)
        telling = (found > RATIO * expected) & (found - expected > SURE * np.sqrt(expected + 1)) & (_found_in(value, toxic.document[word], len(known)) >= least)
        marked[word[telling[value]]] = True
        for lot in lots:
            at, of = _known(lot, n, known[telling])
            known_words.update(lot.text.tobytes()[lot.begins[k] : lot.begins[k + 1] - 1] for k in np.unique(of).tolist())
    return marked, known_words


def _known(windows: _Windows, n: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``known``, which are sorted, the pieces of ``windows`` are, and the words of these pieces."""
    values, word = windows.grams(n)
    at = np.searchsorted(known, values)
    there = np.flatnonzero(np.append(known, 0)[at] == values)
    there = there[at[there] < len(known)]
    return at[there], word[there]


def dictionaries(bad: list[list[bytes]], good: list[list[bytes]]) -> dict[int, Model]:
    """For each size the two dictionaries of labelled texts, as a model without weights."""
    marked, known = telling_words(bad, good)
    samples, at = [], 0
    for words in bad:
        mine = [words[k] for k in np.flatnonzero(marked[at : at + len(words)])]
        samples += [_window(b" ".join(mine))] if mine else []
        at += len(words)
    counts = Counter(w for words in good for w in words)
    stretches = [_window(b" ".join(words[k : k + 12])) for words in good for k in range(0, len(words), 60)]
    return {size: _pair(samples or [_window(b" ".join(words)) for words in bad], stretches, counts, known, size) for size in SIZES}


def _pair(samples: list[bytes], stretches: list[bytes], counts: Counter, known: set[bytes], size: int) -> Model:
    toxic_side, common, hard = _trained(samples, size), _trained(stretches, size), Counter()
    model = Model(toxic_side, common, np.zeros(0))
    for _ in range(ROUNDS):
        wrong = {w: n for w, n in counts.items() if w not in known and model.difference(w) >= STEPS[0]}
        if not wrong:
            break
        hard.update(wrong)
        taken, room = [], size // 2
        for w in sorted(hard, key=lambda w: (-hard[w], w)):
            if (room := room - len(w) - 2) < 0:
                break
            taken.append(_window(w))
        model = Model(toxic_side, (common[: size // 2] + b"".join(reversed(taken))).rjust(size, b"\0"), np.zeros(0))
    return model


def fold_of(doc_id: int) -> int:
    return zlib.crc32(f"fold {doc_id}".encode()) % FOLDS


def fitted(ids: list[int], texts: list[str], toxic: list[bool], fold: int) -> pd.DataFrame:
    """Rows (fold, size, toxic_side, ordinary_side, doc_id, toxic, x): the held fold described by dictionaries of the others,
    or for fold ``FOLDS`` the dictionaries of all rows."""
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    mine = [i for i in order if fold_of(ids[i]) == fold]
    bad, good = ([words_of(texts[i]) for i in order if toxic[i] == kind and fold_of(ids[i]) != fold] for kind in (True, False))
    rows: list[tuple] = []
    if bad and good:
        for size, model in dictionaries(bad, good).items():
            rows += [(fold, size, None, None, ids[i], bool(toxic[i]), model.described(texts[i]).tolist()) for i in mine]
            rows += [(fold, size, model.toxic, model.ordinary, None, None, None)] if fold == FOLDS else []
    return pd.DataFrame(rows, columns=[f.split()[0] for f in FITTED.split(", ")]).astype({"doc_id": "Int64"})


def chosen(rows: list, share: float = 1.0) -> Model:
    """The model with the size of least log loss over the folds (see above), calibrated on descriptions out of fold. ``share``: how
    many times rarer toxic rows are among all labelled rows than in the sample."""
    sides = {r["size"]: (bytes(r["toxic_side"]), bytes(r["ordinary_side"])) for r in rows if r["fold"] == FOLDS}
    losses, models = [], []
    for size in sorted(sides):
        told = sorted((r["doc_id"], r["fold"], r["toxic"], r["x"]) for r in rows if r["size"] == size and r["fold"] < FOLDS)
        x, y, fold = np.array([t[3] for t in told]), np.array([float(t[2]) for t in told]), np.array([t[1] for t in told])
        if len(set(y)) < 2:
            continue
        counts, loss = np.where(y > 0, share, 1.0), np.zeros(len(y))
        for k in range(FOLDS):
            z = np.clip(x[fold == k] @ _logistic(x[fold != k], y[fold != k], counts[fold != k]), -30, 30)
            loss[fold == k] = counts[fold == k] * np.log1p(np.exp(np.where(y[fold == k] > 0, -z, z)))
        losses.append(loss)
        models.append(Model(*sides[size], _logistic(x, y, counts)))
    if not models:
        return Model(b"", b"", np.zeros(0))
    least = losses[int(np.argmin([loss.sum() for loss in losses]))]
    # The smallest size whose loss is above the least one by no more than the deviation of that difference.
    return next(m for m, loss in zip(models, losses) if (loss - least).sum() <= (loss - least).std() * np.sqrt(len(loss)))


def _logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic weights by Newton steps; ``counts``: rows that each row stands for."""
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (counts * p * (1 - p))[:, None]) + shrink, x.T @ (counts * (y - p)) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    The ids are chosen among the labels first, so that one pass over the documents finds their texts.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    picked = [known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for toxic in (True, False)]
    # Twice SAMPLE_ROWS ids at most, and one text for each. An empty text has nothing to learn from.
    usable = docs.select("doc_id", "text").where(F.length("text") > 0)
    texts = usable.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # Each of FOLDS + 1 tasks gets the whole sample.
    sample = checkpointed(texts).select("doc_id", "toxic", "text", F.explode(F.array(*map(F.lit, range(FOLDS + 1)))).alias("fold"))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return fitted(frame["doc_id"].tolist(), frame["text"].tolist(), frame["toxic"].tolist(), int(key[0]))

    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = min(SAMPLE_ROWS, n.get(False, 1)) / n.get(False, 1) * n.get(True, 1) / min(SAMPLE_ROWS, n.get(True, 1))
    return chosen(sample.groupBy("fold").applyInPandas(one, FITTED).collect(), share)


@lru_cache(maxsize=1)
def _loaded(state: tuple) -> Model:
    return Model(state[0], state[1], np.frombuffer(state[2]))


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row. The model is a few KB and travels with the tasks."""
    state = (model.toxic, model.ordinary, model.weights.tobytes())

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = _loaded(state)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["k"].astype("Int64"), "score": [mine.score(t) for t in frame["t"]]})

    return docs.select(docs[doc_id].alias("k"), docs[text].alias("t")).mapInPandas(batches, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, all columns as they were."""
    state = (model.toxic, model.ordinary, model.weights.tobytes())

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mine = _loaded(state)
        for part in texts:
            yield pd.Series([mine.score(t) for t in part], dtype="float64")

    return docs.where(score(F.col("text")) < 0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
