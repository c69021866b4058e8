"""Landed page dumps as a Spark data source: JSON lines, in splits for a batch and with offsets for a stream.

``spark.read.format("page_dumps").load(folder)`` reads files in splits of ``splitBytes`` bytes; a line belongs to the
split in which it begins. ``spark.readStream`` takes up what has been appended or has landed since, in micro-batches of
``maxBytes`` bytes at most (a longer line is taken whole): its offset is the number of bytes read of each file, up to a
line's end, so a query that stops goes on where it was, and a line that is still being written waits. Lines that are no
records become rows with an ``error`` and the line itself, so nothing is lost on the way.

The folder is one that driver and tasks see under one path, such as a mounted share. A run with ``availableNow`` takes one
micro-batch, as Spark asks sources in Python for one offset then.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a split, and of a micro-batch.
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 256 << 20
SCHEMA = "page_id long, title string, canonical_url string, raw_text string, categories array<string>, fetched_at double, file string, at long, error string"


class Split(InputPartition):
    """The lines of a file that begin in [start, end)."""

    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def _files(folder: str) -> list[tuple[str, int]]:
    """Files and sizes below a folder that driver and tasks see, by name; names that begin with a dot or underscore are left out."""
    found = []
    for at, folders, names in os.walk(_local(folder)):
        folders[:] = [f for f in folders if f[0] not in "._"]
        found += [(os.path.join(at, n), os.path.getsize(os.path.join(at, n))) for n in names if n[0] not in "._"]
    return sorted(found)


def record(line: bytes, file: str, at: int) -> tuple:
    """The row of a line."""
    try:
        page = json.loads(line)
        if not isinstance(page, dict) or not isinstance(page.get("title"), str):
            raise ValueError("no title")
        text, categories = page.get("raw_wikitext") or "", page.get("categories") or []
        number, fetched = page.get("page_id"), page.get("fetched_at")
        return (
            None if number is None else int(number), page["title"], page.get("canonical_url"), str(text), [str(c).removeprefix("Category:") for c in categories],
            None if fetched is None else float(fetched), file, at, None,
        )
    except (ValueError, TypeError) as error:
        return (None, None, None, line.decode("utf-8", "replace"), None, None, file, at, f"not a record: {type(error).__name__}")


def lines(split: Split) -> Iterator[tuple]:
    """Rows of the lines that begin in a split."""
    with open(split.file, "rb") as f:
        at = split.start
        if at:
            # The line that reaches into the split belongs to the one before.
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < split.end and (line := f.readline()):
            if line.strip():
                yield record(line.rstrip(b"\r\n"), split.file, at)
            at += len(line)


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        return [Split(file, start, min(size, start + self.split)) for file, size in _files(self.folder) for start in range(0, size, self.split)]

    def read(self, partition: Split) -> Iterator[tuple]:
        return lines(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.split, self.most = options["path"], int(options.get("splitBytes", SPLIT_BYTES)), int(options.get("maxBytes", BATCH_BYTES))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """What may be read next: whole lines, ``maxBytes`` of them in all after the offset that was given out last."""
        room, found = self.most, dict(self.known)
        for file, size in _files(self.folder):
            start = found.get(file, 0)
            if size <= start or room <= 0:
                continue
            end = _line_end(file, start, min(size, start + room))
            if end > start:
                room -= end - start
                found[file] = end
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[Split]:
        # After a restart the offsets of the last batch are known by this call.
        self.known = {**self.known, **{f: max(n, self.known.get(f, 0)) for f, n in end.items()}}
        return [Split(file, at, min(to, at + self.split)) for file, to in sorted(end.items()) for at in range(start.get(file, 0), to, self.split)]

    def read(self, partition: Split) -> Iterator[tuple]:
        return lines(partition)

    def commit(self, end: dict) -> None:
        self.known = {**self.known, **{f: max(n, self.known.get(f, 0)) for f, n in end.items()}}


def _line_end(file: str, start: int, want: int, block: int = 1 << 20) -> int:
    """The end of the last whole line in [start, want); of the first one if it is longer; ``start`` if none is whole yet."""
    with open(file, "rb") as f:
        at = want
        while at > start:
            low = max(start, at - block)
            f.seek(low)
            if (cut := f.read(at - low).rfind(b"\n")) >= 0:
                return low + cut + 1
            at = low
        f.seek(want)
        while chunk := f.read(block):
            if (cut := chunk.find(b"\n")) >= 0:
                return f.tell() - len(chunk) + cut + 1
    return start


class PageDumps(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_dumps"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageDumps)
