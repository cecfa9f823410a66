"""Exports that grow, as a Spark data source: a stream of commits, each of them once.

    register(spark)
    commits = spark.readStream.format("keysieve_export").load("/exports")
    stream_findings(added_lines(split_commits(commits)), rules, keep=("seq", "repo"))

The offset of the stream is, for each file, the place up to which its commits are
complete: a commit is, once another one begins behind it. Asking for the newest
offset reads the ends of files that have grown, on the driver; commits themselves
are read by tasks, a range of a file each. A commit belongs to the range in which
it begins and is read whole.

Options: ``record`` is how a record begins (``commit ``, or ``diff --git `` for staged
diffs), ``closed`` says that files are complete as they are, and ``range_bytes``
is the size of a range. Files must be appended to, as ``git log --reverse`` output
is; a file that has become shorter is an error. Read in a batch, files are closed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from keysieve.sources.stores import store_of

NAME = "keysieve_export"
SCHEMA = "repo string, seq struct<file: string, at: bigint>, text string"
ARROW = pa.schema([("repo", pa.string()), ("seq", pa.struct([("file", pa.string()), ("at", pa.int64())])), ("text", pa.string())])
RANGE_BYTES = 64 << 20
STEP = 1 << 20
BATCH_BYTES = 16 << 20


@dataclass
class ExportRange(InputPartition):
    """The records of a file that begin in a range; the last one ends at ``limit`` at the latest."""

    address: str
    name: str
    start: int
    end: int
    limit: int


def last_record(handle, size: int, least: int, mark: bytes) -> int | None:
    """Where the last record of a file begins, not before ``least``."""
    border = b"\n" + mark
    end, step = size, max(STEP, 2 * len(border))
    while end > least:
        start = max(least - 1, end - step, 0)
        handle.seek(start)
        part = handle.read(min(end, size) - start)
        found = part.rfind(border)
        if found >= 0 and start + found + 1 >= least:
            return start + found + 1
        if start <= max(least - 1, 0):
            break
        end = start + len(border) - 1
    handle.seek(least)
    return least if handle.read(len(mark)) == mark else None


def next_record(handle, place: int, limit: int, mark: bytes) -> int:
    """Where the first record at or after ``place`` begins; ``limit`` if there is none before."""
    border = b"\n" + mark
    if place == 0:
        handle.seek(0)
        if handle.read(len(mark)) == mark:
            return 0
    start = max(place - 1, 0)
    kept = b""
    handle.seek(start)
    while start < limit and (part := handle.read(min(STEP, limit - start))):
        whole = kept + part
        found = whole.find(border)
        if found >= 0:
            return min(start - len(kept) + found + 1, limit)
        kept, start = whole[-(len(border) - 1) :], start + len(part)
    return limit


def records(handle, start: int, end: int, limit: int, mark: bytes) -> Iterator[tuple[int, bytes]]:
    """The records that begin at or after ``start`` and before ``end``, with their places."""
    at = next_record(handle, start, limit, mark)
    while at < end and at < limit:
        after = next_record(handle, at + 1, limit, mark)
        handle.seek(at)
        yield at, handle.read(after - at).removesuffix(b"\n")
        at = after


class Exports:
    """What the stream and the batch share: files, ranges, and reading a range."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.mark = options.get("record", "commit ").encode()
        self.closed = options.get("closed", "false").lower() == "true"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def files(self) -> dict[str, int]:
        """The sizes of the files of the folder, or of the one file, by name."""
        store, path = store_of(self.root)
        entry = store.root(path)
        if entry is None or not entry.folder:
            return {} if entry is None else {"": store.size(path)}
        plain = (e for e in store.entries(path) if not e.folder and not e.name.startswith((".", "_")))
        return {e.name: store.size(e.path) for e in plain}

    def open(self, name: str):
        store, path = store_of(self.root)
        return store.open(f"{path}/{name}" if name else path)

    def complete(self, name: str, size: int, known: int, closed: bool) -> int:
        """The place up to which the records of a file are complete."""
        if size < known:
            raise ValueError(f"{self.root}/{name} has become shorter; exports are appended to")
        if closed or size == known:
            return size
        with self.open(name) as handle:
            return last_record(handle, size, known, self.mark) or known

    def ranges(self, start: dict, end: dict) -> list[ExportRange]:
        found = []
        for name, limit in sorted(end.items()):
            for low in range(start.get(name, 0), limit, self.range_bytes):
                found.append(ExportRange(self.root, name, low, min(low + self.range_bytes, limit), limit))
        return found

    def read(self, part: ExportRange) -> Iterator[pa.RecordBatch]:
        repo = re.sub(r"\.[^.]*$", "", part.name or os.path.basename(self.root.rstrip("/")))
        places, texts, held = [], [], 0

        def batch() -> pa.RecordBatch:
            seq = pa.array([{"file": part.name, "at": at} for at in places], ARROW.field("seq").type)
            text = pa.array(texts, pa.binary()).view(pa.string())  # bytes stay as they are
            return pa.RecordBatch.from_arrays([pa.array([repo] * len(texts), pa.string()), seq, text], schema=ARROW)

        with self.open(part.name) as handle:
            for at, text in records(handle, part.start, part.end, part.limit, self.mark):
                places.append(at)
                texts.append(text)
                held += len(text)
                if held >= BATCH_BYTES:
                    yield batch()
                    places, texts, held = [], [], 0
        if texts:
            yield batch()


class ExportStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.exports = Exports(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The completed place of every file; what was found before is not searched again."""
        for name, size in self.exports.files().items():
            self.known[name] = self.exports.complete(name, size, self.known.get(name, 0), self.exports.closed)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[ExportRange]:
        self.known = {**start, **self.known}
        return self.exports.ranges(start, end)

    def read(self, partition: ExportRange) -> Iterator[pa.RecordBatch]:
        return self.exports.read(partition)


class ExportBatch(DataSourceReader):
    def __init__(self, options: dict):
        self.exports = Exports(options)

    def partitions(self) -> list[ExportRange]:
        ends = {name: self.exports.complete(name, size, 0, True) for name, size in self.exports.files().items()}
        return self.exports.ranges({}, ends) or [ExportRange(self.exports.root, "", 0, 0, 0)]

    def read(self, partition: ExportRange) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition.limit == 0 else self.exports.read(partition)


class ExportSource(DataSource):
    """``(repo, seq, text)``: one record per row, for :func:`keysieve.sources.patches.split_commits`."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExportBatch:
        return ExportBatch(dict(self.options))

    def streamReader(self, schema) -> ExportStream:
        return ExportStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExportSource)
