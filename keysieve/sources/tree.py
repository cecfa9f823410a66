"""Directory trees on a file system or in a store that all executors reach.

Spark's own file readers leave out names starting with a dot or an underscore
and empty files, which is where credentials like to be. So a manifest is
listed first, level by level, with one row per folder to visit: one task reads the
names of a folder, and all tasks share the work of asking for sizes. Then the
selected files are read in tasks balanced by size, large ones in ranges of lines.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysieve.functions.globs import PathMatcher, ignore_lines
from keysieve.operators.files import EXCLUDED, SELECTED, SNIFF_BYTES, inspect_files, select_files
from keysieve.sources.rulesets import MAX_FILE_SIZE_MB
from keysieve.sources.scratch import materialized, scratch_path
from keysieve.sources.stores import Stores, local_path, read_lines_of, reason, store_of

IGNORE_FILE = ".keysieveignore"
SKIPPED_FOLDER = ".git"
BATCH_BYTES = 32 << 20
BATCH_ROWS = 10_000
TASK_BYTES = 128 << 20
#: Files of more bytes are read in ranges of so many by a scan.
RANGE_BYTES = 64 << 20

ENTRY_SCHEMA = (
    "root_ord int, root string, abs_path string, path string, size bigint, folder boolean, named boolean,"
    " error string"
)
ENTRY_ARROW = pa.schema(
    [
        ("root_ord", pa.int32()), ("root", pa.string()), ("abs_path", pa.string()),
        ("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_()), ("named", pa.bool_()),
        ("error", pa.string()),
    ]
)


def scan_root(roots: list[str]) -> str:
    """Where the ignore file and the project rules are: the first root, or its
    folder if it is a file."""
    store, path = store_of(roots[0])
    found = store.root(path)
    if found is None or found.folder:
        return roots[0].rstrip("/") or "/"
    return roots[0][: roots[0].rfind("/")] if "/" in roots[0] else "."


def read_ignore(root: str, name: str = IGNORE_FILE) -> list[str]:
    """Patterns of the ignore file at the root; none if there is no such file."""
    store, path = store_of(root)
    try:
        with store.open(f"{path}/{name}") as handle:
            return ignore_lines(handle.read().decode("utf-8", "replace"))
    except FileNotFoundError:
        return []


def _entries(folder: dict, store) -> Iterator[dict]:
    """Regular files and sub-folders of one folder."""
    for entry in store.entries(folder["abs_path"]):
        if not (entry.folder and entry.name == SKIPPED_FOLDER):
            path = f"{folder['path']}/{entry.name}" if folder["path"] else entry.name
            yield {
                "root_ord": folder["root_ord"], "root": folder["root"], "abs_path": entry.path,
                "path": path, "size": entry.size, "folder": entry.folder, "named": False, "error": None,
            }


def _unlisted(folder: dict, problem: OSError) -> dict:
    """A folder below a root that vanished or may not be read, as an entry that could not be read."""
    return {**folder, "size": None, "folder": False, "named": False, "error": reason(problem)}


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores = Stores()
    for batch in batches:
        for folder in batch.to_pylist():
            found = _entries(folder, stores[folder["root"]])
            while True:
                rows = []
                try:
                    rows.extend(itertools.islice(found, BATCH_ROWS))
                except OSError as problem:
                    if folder["named"]:  # a root that cannot be listed is an error
                        raise
                    rows.append(_unlisted(folder, problem))
                if not rows:
                    break
                yield pa.RecordBatch.from_pylist(rows, ENTRY_ARROW)


def _ask_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sizes of files whose store does not tell them when it lists a folder."""
    stores = Stores()
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            if row["size"] is None and row["error"] is None and not row["folder"]:
                try:
                    row["size"] = stores[row["root"]].size(row["abs_path"])
                except OSError as problem:
                    row["error"] = reason(problem)
        yield pa.RecordBatch.from_pylist(rows, ENTRY_ARROW)


def _roots(roots: list[str]) -> list[tuple]:
    """The roots as entries. A file given as root is named by itself."""
    rows = []
    for ordinal, root in enumerate(roots):
        store, absolute = store_of(root)
        entry = store.root(absolute)
        if entry is None:
            continue
        if not entry.folder:
            rows.append((ordinal, root, absolute, entry.name, entry.size, False, True, None))
        elif entry.name != SKIPPED_FOLDER:
            rows.append((ordinal, root, absolute, "", None, True, True, None))
    return rows


def list_tree(spark: SparkSession, roots: list[str], matcher: PathMatcher) -> DataFrame:
    """The manifest, without content: one row per file, and per pruned folder.

    One job per level of the tree; an excluded folder is not entered. Every
    level is a written table, so a lost executor repeats its own listing only.
    """
    base = scratch_path(spark, "tree")
    excluded = matcher.directory_excluded(F.col("path"))
    level = spark.createDataFrame(_roots(roots), ENTRY_SCHEMA)
    depth = 0
    while True:
        level.write.parquet(f"{base}/level={depth}")
        written = spark.read.schema(ENTRY_SCHEMA).parquet(f"{base}/level={depth}")
        folders = written.filter("folder").filter(F.col("named") | ~excluded)
        count = folders.count()
        if count == 0:
            break
        tasks = min(count, 4 * spark.sparkContext.defaultParallelism)
        named = folders.repartition(tasks, "abs_path").mapInArrow(_list_folders, ENTRY_SCHEMA)
        # a fixed number of tasks: what they wait for is the file system, not the few bytes of a row
        level = named.repartition(spark.sparkContext.defaultParallelism, "abs_path").mapInArrow(_ask_sizes, ENTRY_SCHEMA)
        depth += 1
    entries = spark.read.schema(ENTRY_SCHEMA).parquet(*(f"{base}/level={d}" for d in range(depth + 1)))
    return entries.filter(~F.col("folder") | (~F.col("named") & excluded))


def _read_files(skip_binary: bool):
    """A function that adds content and error; files to be skipped are not read whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        for batch in batches:
            content, errors, start, held = [], [], 0, 0
            places = batch.schema.get_field_index("error")
            carried = [c for i, c in enumerate(batch.columns) if i != places]
            names = [n for i, n in enumerate(batch.schema.names) if i != places]

            def part(stop, start=0):
                columns = [c.slice(start, stop - start) for c in carried]
                return pa.RecordBatch.from_arrays(
                    [*columns, pa.array(content, pa.binary()), pa.array(errors, pa.string())],
                    names=[*names, "content", "error"],
                )

            rows = (batch.column(n).to_pylist() for n in ("root", "abs_path", "status", "error", "range_start", "range_end"))
            for at, (root, path, status, error, first, end) in enumerate(zip(*rows)):
                data = None
                if status == SELECTED:
                    try:
                        with stores[root].open(path) as handle:
                            data = handle.read(SNIFF_BYTES)
                            if not skip_binary or b"\x00" not in data:
                                data = read_lines_of(handle, first, end)
                    except OSError as problem:
                        data, error = None, reason(problem)
                content.append(data)
                errors.append(error)
                held += len(data or b"")
                if held >= BATCH_BYTES:
                    yield part(at + 1, start)
                    content, errors, start, held = [], [], at + 1, 0
            if content:
                yield part(batch.num_rows, start)

    return read


def select_tree(
    spark: SparkSession, roots: list[str], matcher: PathMatcher, *, max_mb: int = MAX_FILE_SIZE_MB
) -> DataFrame:
    """The manifest with the status that follows from names and sizes, a written table.

    The tables of the listing are small files that few tasks would read, so the paths
    are spread before they are matched, by what the duplicates are looked for.
    """
    entries = list_tree(spark, roots, matcher).repartition(4 * spark.sparkContext.defaultParallelism, "abs_path")
    chosen = select_files(entries, matcher, max_mb=max_mb, overlapping=len(roots) > 1)
    # a pruned folder is a row of its own
    pruned = F.when(F.col("folder"), F.col("path")).otherwise(F.col("excluded_by"))
    status = F.when(F.col("folder"), EXCLUDED).otherwise(F.col("status"))
    return materialized(chosen.withColumns({"excluded_by": pruned, "status": status}), "manifest")


def ranges_of(chosen: DataFrame, range_bytes: int | None) -> DataFrame:
    """The manifest with ``range_no, range_start, range_end``: a row per range of a selected file of more bytes.

    The last range has no end: it is read to the end of the file.
    """
    size = F.coalesce("size", F.lit(0))
    step = F.lit(range_bytes or 1 << 62)
    last = F.when((F.col("status") == SELECTED) & (size > step), F.floor((size - 1) / step).cast("long")).otherwise(F.lit(0).cast("long"))
    each = chosen.withColumn("_last", last).withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    start = F.col("range_no") * step
    end = F.when(F.col("range_no") < F.col("_last"), start + step)
    return each.withColumns({"range_start": start, "range_end": end}).drop("_last")


def read_selected(chosen: DataFrame, *, skip_binary: bool = False, range_bytes: int | None = None) -> DataFrame:
    """The manifest with the content of the selected files and their final status.

    With ``range_bytes``, a larger file is a row per range, read by tasks of their
    own: ``content`` is the lines that begin in the range, whole, and ``range_no``
    numbers the ranges from 0. A line is never cut, whatever its length.
    """
    each = ranges_of(chosen, range_bytes)
    sizes = chosen.filter(F.col("status") == SELECTED).agg(F.sum("size")).first()[0] or 0
    tasks = max(chosen.sparkSession.sparkContext.defaultParallelism, -(-sizes // TASK_BYTES))
    dropped = ("error", "range_start", "range_end", *(() if range_bytes else ("range_no",)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.schema if f.name != "error")
    read = each.repartition(int(tasks)).mapInArrow(
        _read_files(skip_binary), f"{schema}, content binary, error string"
    )
    return inspect_files(read.drop(*dropped[1:]), skip_binary=skip_binary)


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores = Stores()
    for batch in batches:
        counts = []
        rows = (batch.column(n).to_pylist() for n in ("root", "abs_path", "range_start", "range_end"))
        for root, path, start, end in zip(*rows):
            try:
                with stores[root].open(path) as handle:
                    counts.append(read_lines_of(handle, start, end).count(b"\n"))
            except OSError:  # the pass that reads for the findings reports it
                counts.append(0)
        columns = [batch.column("abs_path"), batch.column("range_no"), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["abs_path", "range_no", "lines"])


def lines_before(chosen: DataFrame, range_bytes: int) -> DataFrame:
    """``(abs_path, range_no, lines_before)`` of every range but the first of its file.

    Only files of several ranges are read for it, a large range by a task of its own.
    """
    large = ranges_of(chosen.filter((F.col("status") == SELECTED) & (F.col("size") > range_bytes)), range_bytes)
    named = large.select("root", "abs_path", "range_no", "range_start", "range_end").filter(F.col("range_end").isNotNull())
    ranges = named.count()
    tasks = min(max(1, ranges), max(chosen.sparkSession.sparkContext.defaultParallelism, -(-ranges * range_bytes // TASK_BYTES)))
    counted = named.repartition(tasks).mapInArrow(_count_lines, "abs_path string, range_no long, lines long")
    before = F.sum("lines").over(Window.partitionBy("abs_path").orderBy("range_no"))
    sums = materialized(counted.select("abs_path", (F.col("range_no") + 1).alias("range_no"), before.alias("lines_before")), "lines-before")
    return sums


def read_tree(
    spark: SparkSession, roots: list[str], matcher: PathMatcher, *, max_mb: int = MAX_FILE_SIZE_MB,
    skip_binary: bool = False,
) -> DataFrame:
    """Every file below the roots with its status, and the content of those scanned."""
    return read_selected(select_tree(spark, roots, matcher, max_mb=max_mb), skip_binary=skip_binary)


def write_tree(texts: DataFrame, root: str) -> None:
    """Write ``(path, text)`` rows as files below ``root``, from the tasks.

    The root must be on a file system that every executor has mounted.
    """
    root = local_path(root)

    def put(rows) -> None:
        for row in rows:
            target = os.path.join(root, row["path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as handle:
                handle.write(bytes(row["content"]))

    texts.select("path", F.col("text").cast("binary").alias("content")).foreachPartition(put)
