"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.sources.scratch import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BROADCAST_BYTES = 32 << 20
HELD_OUT_FOLDS = 5


def worker_memory() -> dict:
    """A dictionary that lives as long as this Python process, whatever task it runs.

    Functions travel to tasks by value and take a copy of their module's state
    along, so module variables start anew with every task.
    """
    return vars(sys).setdefault("_keysieve_memory", {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The frame as a table in the shared scratch folder: lineage ends there."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.option("compression", codec).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def broadcast_if_small(frame: DataFrame, text_columns: list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if its measured size is within the limit.

    A larger one is returned as it is, and its joins are shuffled.
    """
    size = F.lit(64).cast("long")
    for name in text_columns:
        size = size + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    measured = frame.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(frame) if measured <= limit else frame


def held_out(doc_id: Column | str, folds: int = HELD_OUT_FOLDS) -> Column:
    """Whether crc32 of the id as text leaves no remainder."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str)
                  else F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0


def fold_of(doc_id: int, folds: int = HELD_OUT_FOLDS) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def sigmoid(value: float) -> float:
    return 1.0 / (1.0 + math.exp(-value)) if value >= 0 else math.exp(value) / (1.0 + math.exp(value))


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not use, whatever the letter case."""
    used = {c.lower() for c in frame.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def per_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int) -> Callable:
    """An Arrow iterator function that works on at most so many rows at a time.

    Batches are cut, never shortened: every row is handled. Texts are readable in
    Python: bytes that are not UTF-8 have become U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield work(readable(batch.slice(start, rows)))

    return run


def readable(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with U+FFFD in its texts where bytes are not UTF-8, which Spark strings may hold."""
    columns = []
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            try:
                column.validate(full=True)
            except pa.ArrowInvalid:
                raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
                texts = [None if one is None else one.decode("utf-8", "replace") for one in raw.to_pylist()]
                column = pa.array(texts, column.type)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def valid_text(column: Column | str) -> Column:
    """The column as text in which bytes that are not UTF-8 have become U+FFFD; Python could not read them."""
    return F.make_valid_utf8((F.col(column) if isinstance(column, str) else column).cast("string"))


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
