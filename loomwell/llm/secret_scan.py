r"""Secret scans by token efficiency.

A byte-pair vocabulary packs ordinary words and identifiers into few tokens; random strings fall apart into many. A
run of ``[A-Za-z0-9+/_=-]`` with 20 characters or more whose characters per token under a tiktoken vocabulary are at
most ``MAX_RATIO`` is reported as ``random``, unless it is a known form that is no secret: a hexadecimal digest of a
usual length, a UUID, a number, or words joined as an identifier (letters only, snake_case, camelCase, paths) if those have more characters per token than that themselves. Fixed
patterns give the kinds ``assign``, ``access`` and ``hex`` beside it; a random run that such a span covers is not
reported again.

Each text is scanned on its own inside Arrow batches, so nothing is shuffled and a lost task is simply run again.

Defined results: a null or empty text has no spans; offsets count code points, the end is exclusive; a null
``doc_id`` is kept; rows given twice come out twice; extra columns are ignored by the query; a very long text is
scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from loomwell.llm.common import table

#: Characters per token up to which a run counts as random, and the shortest run that is looked at.
MAX_RATIO, MIN_RUN = 2.1, 20
#: Fixed patterns and least lengths of the base kinds, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24))
KINDS = ("assign", "access", "hex", "random")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % MIN_RUN)
#: Forms that are no secrets: digests (MD5, SHA-1, SHA-2), UUIDs, plain numbers.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.IGNORECASE)
NUMBER = re.compile(r"[0-9+/_=-]+")
WORDS = re.compile(r"[+/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[+/_=-]*|[a-z]*(?:[A-Z][a-z]+)*[0-9]{0,4}")

PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


@lru_cache(maxsize=4)
def encoding(path: str | None):
    """The vocabulary of ranks at ``path`` (default: the public 50k byte-level one)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns."""
    return sorted((m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if len(m[group]) >= least)


def is_known(run: str, path: str | None = None) -> bool:
    if DIGEST.fullmatch(run) or UUID.fullmatch(run) or NUMBER.fullmatch(run):
        return True
    if not WORDS.fullmatch(run):
        return False
    # Letters in the form of an identifier are one if they are words to the vocabulary, as they would stand in a sentence.
    parts = PART.findall(run)
    return sum(map(len, parts)) > MAX_RATIO * sum(len(encoding(path).encode_ordinary(" " + part.lower())) for part in parts)


def random_spans(text: str, taken: list[tuple[int, int, int]], path: str | None = None) -> list[tuple[int, int, int]]:
    """Runs of few characters per token that no span of ``taken``, sorted, overlaps."""
    found, ahead, reached = [], iter([*taken, (len(text) + 1, 0, 0)]), 0
    span = next(ahead)
    for m in RUN.finditer(text):
        while span[0] < m.end():
            reached, span = max(reached, span[2]), next(ahead)
        run = m[0].strip("=-/_+")
        if len(run) < MIN_RUN or reached > m.start() or is_known(run, path):
            continue
        if len(run) <= MAX_RATIO * len(encoding(path).encode_ordinary(run)):
            found.append((m.start(), KINDS.index("random"), m.end()))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str | None, path: str | None = None) -> tuple[list, list]:
    """The base spans and all spans of a text, each sorted."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, path))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, body in zip(frame["k"], frame["t"]):
                base, spans = scan(body, vocabulary)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(len(KINDS))]
                rows.append((key, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(docs[doc_id].alias("k"), docs[text].alias("t")).mapInPandas(batches, SCHEMA)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op8_secret_scan": op8_secret_scan}
