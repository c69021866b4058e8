"""Media columns: payloads as lossless WebP images, written, read back and described.

A payload is the UTF-8 text with zero bytes up to a positive multiple of 64. It becomes a grey image of 8-bit samples,
64 to a row (rows are widened by whole multiples where an image would be taller than the format allows, and the last
row is then filled with zeros). The file is what is stored; digests and features come from the decoded pixels. Files
hold prefix codes and back-references, and the palette or predictor transform where an image gains by it; the decoder
reads those, colour caches and cross-colour transforms of any file alike.

Work is done in Arrow batches cut to a few MB of samples; nothing is shuffled, and a lost task is run again.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal files and features; a null ``doc_id``
and rows given twice are kept; ``decode_images`` gives null pixels and the reason for bytes that are no lossless WebP;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from loomwell.llm import vp8l
from loomwell.llm.common import table

ROW = 64
#: Samples and images that are coded together.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 8000
#: Samples of one image: as many as its greatest height and width allow.
IMAGE_BYTES = vp8l.MAX_SIDE * (vp8l.MAX_SIDE // ROW * ROW)
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes of a text and how many of them are its own."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def to_images(payload: bytes) -> list[np.ndarray]:
    """The payload's images, all but the last of full size."""
    images = []
    for at in range(0, len(payload), IMAGE_BYTES):
        part = payload[at : at + IMAGE_BYTES]
        width = ROW * -(-len(part) // (ROW * vp8l.MAX_SIDE))
        images.append(np.frombuffer(part + b"\0" * (-len(part) % width), np.uint8).reshape(-1, width))
    return images


def feature_of(images: list[np.ndarray]) -> str:
    """Sizes, mean and variance of the samples, mean step along rows, and the number of levels; whole-number sums, so the same everywhere."""
    levels, place = sum(np.bincount(x.ravel(), minlength=256) for x in images), np.arange(256)
    n, total, squares = int(levels.sum()), int(levels @ place), int(levels @ place**2)
    steps = sum(int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum()) for x in images)
    sizes = "+".join(f"{x.shape[1]}x{x.shape[0]}" for x in images)
    return f"{sizes};mean={total / n:.4f};var={(squares * n - total * total) / (n * n):.4f};step={steps / n:.4f};levels={int((levels > 0).sum())}"


def _groups(payloads: list[tuple[bytes, int]]) -> Iterator[slice]:
    first, size = 0, 0
    for k, (payload, _) in enumerate(payloads):
        if k > first and (size + len(payload) > BATCH_BYTES or k - first >= BATCH_ROWS):
            yield slice(first, k)
            first, size = k, 0
        size += len(payload)
    if first < len(payloads):
        yield slice(first, len(payloads))


def _encoded(payloads: list[bytes]) -> list[list[bytes]]:
    """The files of each payload's images; all images are coded together."""
    images = [to_images(p) for p in payloads]
    files = iter(vp8l.encode_batch([x for of in images for x in of]))
    return [[next(files) for _ in of] for of in images]


def described(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of SCHEMA for (k, t): each text written as a file and read back."""
    payloads = [to_payload(t) for t in frame["t"]]
    for part in _groups(payloads):
        rows, own = [], payloads[part]
        files = _encoded([p for p, _ in own])
        decoded = iter(vp8l.decode_batch([f for of in files for f in of]))
        for key, (payload, n), mine in zip(frame["k"][part], own, files):
            images, file = [next(decoded) for _ in mine], b"".join(mine)
            back = b"".join(x.tobytes() for x in images)[: len(payload)]
            rows.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(file), hashlib.sha256(file).hexdigest(), feature_of(images)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})


def describe_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from described(frame)

    return docs.select(docs[doc_id].alias("k"), docs[text].alias("t")).mapInPandas(batches, SCHEMA)


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, files): every text as lossless WebP files, one unless it is very large."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            payloads = [to_payload(t) for t in frame["t"]]
            for part in _groups(payloads):
                files = _encoded([p for p, _ in payloads[part]])
                yield pd.DataFrame({"doc_id": frame["k"][part].astype("Int64"), "n_bytes": [n for _, n in payloads[part]], "files": files})

    return docs.select(docs[doc_id].alias("k"), docs[text].alias("t")).mapInPandas(batches, "doc_id long, n_bytes long, files array<binary>")


def decode_images(files: DataFrame, key: str, file: str) -> DataFrame:
    """(key, width, height, argb little-endian bytes, error) of any lossless WebP files in a binary column."""
    kind = files.schema[key].dataType.simpleString()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, data in zip(frame["k"], frame["f"]):
                try:
                    pixels = vp8l.decode(bytes(data or b""))
                    rows.append((k, pixels.shape[1], pixels.shape[0], pixels.astype("<u4").tobytes(), None))
                except (ValueError, IndexError) as error:
                    rows.append((k, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["key", "width", "height", "argb", "error"]).astype({"width": "Int64", "height": "Int64"})

    return files.select(files[key].alias("k"), files[file].alias("f")).mapInPandas(batches, f"key {kind}, width long, height long, argb binary, error string")


def op1_webp_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a lossless WebP file and described from its pixels."""
    return describe_media(table(spark, sf_dir, "documents"))


QUERIES = {"op1_webp_lossless": op1_webp_lossless}
