"""File policy: which files are read, and what became of the others.

A manifest has one row per file: ``root_ord, root, abs_path, path, size,
content, error``. ``content`` may still be missing when only names and sizes
are known; :func:`select_files` needs no more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.functions.globs import PathMatcher
from keysieve.sources.rulesets import MAX_FILE_SIZE_MB

# Fixed values of the file policy.
MEGABYTE = 1024 * 1024
SNIFF_BYTES = 512

EXCLUDED, UNREADABLE, OVERSIZED = "excluded", "unreadable", "oversized"
RANGE = "range_no"
DUPLICATE, BINARY, SCANNED, SELECTED = "duplicate", "binary", "scanned", "selected"


def is_binary(content: Column) -> Column:
    """A zero byte near the start. Text in UTF-16 has some too, so skipping such files is an option."""
    return F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\x00"))


def select_files(
    manifest: DataFrame, matcher: PathMatcher, *, max_mb: int = MAX_FILE_SIZE_MB, overlapping: bool = True
) -> DataFrame:
    """Adds ``excluded_by`` and ``status`` from names and sizes alone.

    Files under several roots count for the first root, after the exclusion
    and size checks. Pass ``overlapping=False`` when the roots are known to be
    disjoint: the pass is then free of a shuffle. If the manifest holds
    contents, the few files that are repeated are joined to it, and adaptive
    execution broadcasts them if they measure small. ``max_mb`` is a limit only
    if it is above 0.
    """
    excluded_by = matcher.excluded_by(F.col("path"))
    if "named" in manifest.columns:  # a file that is itself a root is never excluded
        excluded_by = F.when(~F.col("named"), excluded_by)
    rows = manifest.withColumn("excluded_by", excluded_by)
    limit = max_mb * MEGABYTE
    status = (
        F.when(F.col("excluded_by").isNotNull(), EXCLUDED)
        .when(F.col("size").isNull(), UNREADABLE)
        .when((F.lit(limit) > 0) & (F.col("size") > limit), OVERSIZED)
        .otherwise(SELECTED)
    )
    rows = rows.withColumn("status", status)
    if not overlapping:
        return rows
    chosen = F.col("status") == SELECTED
    if "content" in rows.columns:
        rows = rows.join(_repeated(rows.filter(chosen)), "abs_path", "left")
    else:
        wanted = F.when(chosen, F.col("root_ord"))
        rows = rows.withColumn("_first", F.min(wanted).over(Window.partitionBy("abs_path")))
    later = chosen & F.coalesce(F.col("root_ord") > F.col("_first"), F.lit(False))
    status = F.when(later, DUPLICATE).otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_first")


def _repeated(rows: DataFrame) -> DataFrame:
    """``(abs_path, _first)`` of the files below several roots."""
    seen = rows.groupBy("abs_path").agg(
        F.min("root_ord").alias("_first"), F.count(F.lit(1)).alias("_roots")
    )
    return seen.filter("_roots > 1").drop("_roots")


def inspect_files(files: DataFrame, *, skip_binary: bool = False) -> DataFrame:
    """Settles the selected files once their content (or a read error) is there.

    Every file that could be read is scanned, unless ``skip_binary`` leaves out
    those with a zero byte near the start.
    """
    settled = F.when(F.col("error").isNotNull() | F.col("content").isNull(), UNREADABLE)
    if skip_binary:
        settled = settled.when(is_binary(F.col("content")), BINARY)
    return files.withColumn(
        "status", F.when(F.col("status") == SELECTED, settled.otherwise(SCANNED)).otherwise(F.col("status"))
    )


def unread(files: DataFrame) -> DataFrame:
    """``(path, status, error)`` of every file that should have been scanned and could not be read."""
    lost = files.filter(F.col("status") == UNREADABLE)
    rows = lost.select("path", "status", F.coalesce("error", F.lit("unreadable")).alias("error"))
    return rows.distinct() if RANGE in files.columns else rows


def file_status(
    manifest: DataFrame, matcher: PathMatcher, *, skip_binary: bool = False, **options
) -> DataFrame:
    """Every file of a manifest with content, with its final status."""
    return inspect_files(select_files(manifest, matcher, **options), skip_binary=skip_binary)


def scanned_texts(files: DataFrame) -> DataFrame:
    """``(path, text)`` of the files that are to be scanned, bytes kept as they are.

    Files read in ranges have a row per range, and ``abs_path, range_no`` besides.
    """
    kept = files.filter(F.col("status") == SCANNED)
    place = ("abs_path", RANGE) if RANGE in files.columns else ()
    return kept.select("path", F.col("content").cast("string").alias("text"), *place)


def status_counters(ranged: bool = False) -> list[Column]:
    """Aggregates over files with a final status.

    Of a file read in ranges, the first range counts; but each range that could not
    be read counts as unreadable, so that no incomplete scan looks complete.
    """
    counted = {
        "files_scanned": SCANNED, "files_unreadable": UNREADABLE,
        "files_oversized": OVERSIZED, "files_binary": BINARY,
    }
    first = F.col(RANGE) == 0 if ranged else F.lit(True)
    return [
        F.count_if((F.col("status") == status) & (F.lit(True) if status == UNREADABLE else first)).alias(name)
        for name, status in counted.items()
    ]


def paths_excluded() -> Column:
    """Excluded paths; an excluded directory counts once. Needs no file content."""
    pruned = F.when(F.col("status") == EXCLUDED, F.struct("root_ord", "excluded_by"))
    return F.count_distinct(pruned).alias("paths_excluded")


def coverage(files: DataFrame) -> DataFrame:
    """One row of counters."""
    return files.agg(*status_counters(RANGE in files.columns), paths_excluded())
