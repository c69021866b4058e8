r"""Fill-in-the-middle transformation of whole texts, cut by a sparse checkpoint index.

A text has units (code points, or what a pattern matches one after the other). While they are counted, the byte and
code-point offset of every ``EVERY``-th unit is recorded; the cut before unit k is then found by binary search among
the records and by a rescan of fewer than ``EVERY`` units from there. So a long text is walked once, the index is some
thousandth of it, and no list of units is ever made.

Two cuts, drawn from a digest of seed and id, part a text into prefix, middle and suffix. Markers in front of the parts
tell them apart; a text that holds a marker, or is empty, stays plain, as does a fixed share of all. Each output gives
its text back (``restored``).

Texts are cut inside Arrow batches, each on its own, so nothing is shuffled and a lost task is simply run again.

Defined results: a null or empty text is empty and plain; a null ``doc_id`` is kept and drawn for like the empty
string; rows with equal id and text have equal results, rows given twice come out twice; very long texts are cut
anywhere like short ones; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import table

#: Units between records, bytes that are counted at once, and bytes of output in a batch.
EVERY, STRETCH, BATCH_BYTES = 1024, 1 << 20, 8 << 20
SEED = 1
#: Markers of prefix, suffix and middle; of 100 texts those that are transformed, and of these with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output binary"


@dataclass
class Checkpoints:
    """Units of a text, and the byte and code-point offsets of every ``every``-th one."""

    text: bytes
    every: int = EVERY
    #: None: units are code points; else each match of the pattern, found over the decoded text, is one.
    pattern: regex.Pattern | None = None
    units: int = 0
    at: list[int] = field(default_factory=list)
    at_bytes: list[int] = field(default_factory=list)
    at_points: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._count_points() if self.pattern is None else self._count_matches()

    def _record(self, unit: int, byte: int, point: int) -> None:
        self.at.append(unit)
        self.at_bytes.append(byte)
        self.at_points.append(point)

    def _count_points(self) -> None:
        whole = np.frombuffer(self.text, np.int8)
        for start in range(0, len(whole), STRETCH):
            # Bytes that begin a code point are those other than 10xxxxxx.
            begins = np.flatnonzero(whole[start : start + STRETCH] >= -64)
            for i in range(-self.units % self.every, len(begins), self.every):
                self._record(self.units + i, start + int(begins[i]), self.units + i)
            self.units += len(begins)

    def _count_matches(self) -> None:
        self.decoded = self.text.decode()
        byte = point = 0
        for m in self.pattern.finditer(self.decoded):
            if self.units % self.every == 0:
                byte, point = byte + len(self.decoded[point : m.start()].encode()), m.start()
                self._record(self.units, byte, point)
            self.units += 1

    def cut(self, unit: int) -> tuple[int, int]:
        """The byte and code-point offset before a unit; the text's end beyond the last one."""
        if unit >= self.units:
            return len(self.text), self.units if self.pattern is None else len(self.decoded)
        k = bisect_right(self.at, unit) - 1
        left, byte, point = unit - self.at[k], self.at_bytes[k], self.at_points[k]
        if self.pattern is None:
            # A code point has four bytes at most.
            near = np.frombuffer(self.text[byte : byte + 4 * (left + 1)], np.int8)
            return byte + int(np.flatnonzero(near >= -64)[left]), point + left
        for i, m in enumerate(self.pattern.finditer(self.decoded, point)):
            if i == left:
                return byte + len(self.decoded[point : m.start()].encode()), m.start()
        raise AssertionError("a record lies before its unit")


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 from a digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(doc_id: int | None, text: bytes, pattern: regex.Pattern | None = None, seed: int = SEED) -> tuple:
    """n, form, code points of prefix and middle, their bytes, and the output."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    h = draws(doc_id, seed)
    index = Checkpoints(text, pattern=pattern)
    if not index.units or any(m in text for m in marks) or h[2] % 100 >= TRANSFORMED:
        return index.units, "plain", None, None, None, None, text
    (b1, p1), (b2, p2) = (index.cut(u) for u in sorted((h[0] % (index.units + 1), h[1] % (index.units + 1))))
    prefix, middle, suffix = marks[0] + text[:b1], marks[2] + text[b1:b2], marks[1] + text[b2:]
    if h[3] % 100 < SUFFIX_FIRST:
        return index.units, "spm", p1, p2 - p1, b1, b2 - b1, suffix + prefix + middle
    return index.units, "psm", p1, p2 - p1, b1, b2 - b1, prefix + suffix + middle


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str | None = None, seed: int = SEED) -> DataFrame:
    r"""The transformed text of every row. ``unit``: a pattern such as ``\X`` or ``\S+\s*``; none: code points."""
    pattern = None if unit is None else regex.compile(unit, regex.DOTALL)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        schema = pa.schema([pa.field(n, t) for n, t in (("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), *((n, pa.int64()) for n in ("prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes")), ("output", pa.binary()))])
        for batch in found:
            rows, held = [], 0
            for key, body in zip(batch.column(0), batch.column(1)):
                rows.append((key.as_py(), *transformed(key.as_py(), body.as_py(), pattern, seed)))
                held += len(rows[-1][-1])
                if held >= BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("k"), body.alias("t")).mapInArrow(batches, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: each marker is in it once."""
    ahead, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substr(F.substring_index(ahead, SUFFIX, 1), F.lit(len(PREFIX) + 1)), middle, F.substring_index(ahead, SUFFIX, -1))
    spm = F.concat(F.substring_index(ahead, PREFIX, -1), middle, F.substr(F.substring_index(ahead, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cuts, and the digests of its output and of the text that this gives back."""
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    output = F.col("output").cast("string")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, F.col("form")), 256).alias("restored_sha256"))


ORACLE = {
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS u, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS v,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS w, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS x FROM d),
f AS (SELECT doc_id, t, n, least(u, v) AS a, greatest(u, v) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR w >= 90 THEN 'plain' WHEN x < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form = 'plain' THEN NULL ELSE a END AS prefix_chars, CASE WHEN form = 'plain' THEN NULL ELSE b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
}
QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
