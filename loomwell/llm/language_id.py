"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW``. In each window one gated recurrent network reads forwards
and one backwards; at every byte their two states give the probabilities of the languages. A document's
probabilities are the means over all of its bytes, and the largest one is the answer.

The network is trained in numpy: backpropagation through time, cross entropy at every byte, Adam. It learns from a
bounded sample: the whole texts of about ``SAMPLE`` documents in all, as many of each language, chosen by a hash;
training windows are drawn from anywhere in them. Only text is an input.

Prediction works in Arrow batches, windows of many documents side by side; nothing is shuffled.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is every text when there is nothing
to learn from; a null ``doc_id`` is kept and counts as held out; rows given twice come out twice; equal sums go to the
language that sorts first; a very long text is read whole; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import table

#: Bytes of a window, states of the network in each direction, and windows computed side by side.
WINDOW, STATES, LANES = 128, 12, 2048
#: Documents in the training sample (all languages together).
SAMPLE = 1200
#: Training: windows in a step, bytes of a window, steps, and the largest step size.
LANES_TRAINED, BYTES_TRAINED, STEPS, RATE = 128, 48, 260, 0.02
#: The symbol after the end of a text.
PAD = 256


def _squash(x: np.ndarray) -> np.ndarray:
    """Logistic function, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Direction:
    """One gated recurrent network: update gate z, reset gate r, candidate n; arrays are (feature, lane)."""

    def __init__(self, rng: np.random.Generator, states: int):
        self.states = states
        self.w = {
            "input": rng.normal(0, 0.3, (3 * states, PAD + 1)).astype(np.float32),
            "state": rng.normal(0, states**-0.5, (3 * states, states)).astype(np.float32),
        }
        self.w["input"][:states] += 1.0  # remember at first

    def step(self, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        s = self.states
        x = np.take(self.w["input"], symbols, axis=1)
        u = self.w["state"] @ h
        x[: 2 * s] += u[: 2 * s]
        gates = _squash(x[: 2 * s])
        z, r = gates[:s], gates[s:]
        n = x[2 * s :]
        n += r * u[2 * s :]
        np.tanh(n, out=n)
        return n + z * (h - n), (symbols, h, z, r, n, u[2 * s :])

    def back(self, trace: tuple, dh: np.ndarray, grad: dict) -> np.ndarray:
        """The gradient at the state before a step; adds the weights' to ``grad``."""
        symbols, h, z, r, n, un = trace
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        dx = np.concatenate((dz, dr, dn))
        du = np.concatenate((dz, dr, dn * r))
        grad["state"] += du @ h.T
        one_hot = np.zeros((len(symbols), PAD + 1), np.float32)
        one_hot[np.arange(len(symbols)), symbols] = 1
        grad["input"] += dx @ one_hot
        return dh * z + self.w["state"].T @ du


class Network:
    def __init__(self, languages: list[str], states: int = STATES, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.backward = Direction(rng, states), Direction(rng, states)
        self.out = {"w": rng.normal(0, 0.3, (len(languages), 2 * states)).astype(np.float32), "b": np.zeros((len(languages), 1), np.float32)}

    def states_of(self, symbols: np.ndarray) -> tuple[np.ndarray, list, list]:
        """States at every byte, (byte, feature, lane), of (byte, lane) symbols."""
        t, lanes = symbols.shape
        s = self.forward.states
        both = np.empty((t, 2 * s, lanes), np.float32)
        traces: tuple[list, list] = ([], [])
        for direction, places, part, trace in ((self.forward, range(t), slice(0, s), traces[0]), (self.backward, range(t - 1, -1, -1), slice(s, 2 * s), traces[1])):
            h = np.zeros((s, lanes), np.float32)
            for k in places:
                h, kept = direction.step(symbols[k], h)
                both[k, part] = h
                trace.append(kept)
        return both, *traces

    def label(self, symbols: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every byte, (byte, language, lane)."""
        t, lanes = symbols.shape
        s = self.forward.states
        logits = np.empty((t, len(self.languages), lanes), np.float32)
        for direction, places, w, first in ((self.forward, range(t), self.out["w"][:, :s], True), (self.backward, range(t - 1, -1, -1), self.out["w"][:, s:], False)):
            h = np.zeros((s, lanes), np.float32)
            for k in places:
                h, _ = direction.step(symbols[k], h)
                if first:
                    np.add(w @ h, self.out["b"], out=logits[k])
                else:
                    logits[k] += w @ h
        return _probabilities(logits)

    def train_step(self, symbols: np.ndarray, answer: np.ndarray, optimiser: "Adam") -> float:
        """One step of backpropagation through time; ``answer`` has the language of each lane."""
        t, lanes = symbols.shape
        s = self.forward.states
        both, ahead, behind = self.states_of(symbols)
        p = _probabilities(np.matmul(self.out["w"], both) + self.out["b"])
        counts = (symbols != PAD).astype(np.float32)
        counts /= counts.sum()
        loss = -float((np.log(p[:, answer, np.arange(lanes)] + 1e-9) * counts).sum())
        p[:, answer, np.arange(lanes)] -= 1
        d = p * counts[:, None, :]
        grad = {"w": np.einsum("tlb,tsb->ls", d, both, optimize=True), "b": d.sum(axis=(0, 2))[:, None]}
        dh = np.matmul(self.out["w"].T, d)
        grads = [grad]
        for direction, trace, places, part in ((self.forward, ahead, range(t - 1, -1, -1), slice(0, s)), (self.backward, behind, range(t), slice(s, 2 * s))):
            grad = {k: np.zeros_like(v) for k, v in direction.w.items()}
            carried = np.zeros((s, lanes), np.float32)
            for k, kept in zip(places, reversed(trace)):
                carried = direction.back(kept, carried + dh[k, part], grad)
            grads.append(grad)
        optimiser.update([self.out, self.forward.w, self.backward.w], grads)
        return loss

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (text, language) over all bytes of each text; zeros for an empty one."""
        counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
        windows = int(counts.sum())
        symbols = np.full((windows, WINDOW), PAD, np.int16)
        first = np.concatenate(([0], np.cumsum(counts)))
        for k, t in enumerate(texts):
            if t:
                symbols[first[k] : first[k + 1]].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        sums = np.empty((windows, len(self.languages)))
        for k in range(0, windows, LANES):
            mine = np.ascontiguousarray(symbols[k : k + LANES].T)
            p = self.label(mine)
            p *= (mine != PAD)[:, None, :]
            sums[k : k + LANES] = p.sum(axis=0).T
        out = np.zeros((len(texts), len(self.languages)))
        if windows:
            np.add.at(out, np.repeat(np.arange(len(texts)), counts), sums)
        return out / np.maximum(1, [len(t) for t in texts])[:, None]


def _probabilities(logits: np.ndarray) -> np.ndarray:
    """Softmax over the middle axis, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


class Adam:
    def __init__(self, rate: float, steps: int):
        self.rate, self.steps, self.done, self.moments = rate, steps, 0, None

    def update(self, weights: list[dict], grads: list[dict]) -> None:
        if self.moments is None:
            self.moments = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()} for w in weights]
        self.done += 1
        norm = float(np.sqrt(sum((g**2).sum() for grad in grads for g in grad.values())))
        rate = self.rate * (1 - 0.9 * self.done / self.steps) * np.sqrt(1 - 0.999**self.done) / (1 - 0.9**self.done)
        for w, grad, moments in zip(weights, grads, self.moments):
            for k, g in grad.items():
                m, v = moments[k]
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def train(pieces: list[tuple[str, str]], steps: int = STEPS, seed: int = 6) -> Network | None:
    """A network from (text, language) pairs, each language as often as the others; None without any."""
    by: dict[str, list[bytes]] = {}
    for text, language in pieces:
        if raw := text.encode("utf-8", "surrogatepass"):
            by.setdefault(language, []).append(raw)
    if not by:
        return None
    languages = sorted(by)
    network, optimiser, rng = Network(languages, seed=seed), Adam(RATE, steps), np.random.default_rng(seed)
    for _ in range(steps):
        answer = rng.integers(0, len(languages), LANES_TRAINED)
        symbols = np.full((BYTES_TRAINED, LANES_TRAINED), PAD, np.int16)
        for lane, a in enumerate(answer):
            mine = by[languages[a]]
            raw = mine[rng.integers(len(mine))]
            at = int(rng.integers(0, max(1, len(raw) - BYTES_TRAINED + 1)))
            part = raw[at : at + BYTES_TRAINED]
            symbols[: len(part), lane] = np.frombuffer(part, np.uint8)
        network.train_step(symbols, answer, optimiser)
    return network


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_on(docs: DataFrame) -> Network | None:
    """Train on a bounded sample of the rows that are not held out."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each, place = max(1, SAMPLE // len(counts)), F.xxhash64("doc_id", "text")
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * each / n))))[F.col("lang")]
    chosen = usable.where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30))
    rows = chosen.select(place.alias("place"), "lang", "text").orderBy("place", "lang", "text").limit(2 * SAMPLE).collect()
    return train([(r["text"], r["lang"]) for r in rows])


def predict(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row. The network is some 80 KB and travels with the tasks."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = [(t or "").encode("utf-8", "surrogatepass") if network and t and any(map(str.isalpha, t)) else b"" for t in frame["t"]]
            answers, scores = ["und"] * len(raw), np.zeros(len(raw))
            at, size = 0, 0
            for k in range(len(raw)):  # some MB of text at a time
                size += len(raw[k])
                if size > 4_000_000 or k == len(raw) - 1:
                    if size:
                        p = network.pooled(raw[at : k + 1])
                        for j in range(at, k + 1):
                            if raw[j]:
                                best = int(p[j - at].argmax())
                                answers[j], scores[j] = network.languages[best], min(1.0, float(p[j - at, best]))
                    at, size = k + 1, 0
            yield pd.DataFrame({"doc_id": frame["k"].astype("Int64"), "lang_pred": answers, "score": scores})

    return docs.select(docs[doc_id].alias("k"), docs[text].alias("t")).mapInPandas(batches, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit_on(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
