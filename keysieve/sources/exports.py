"""History and staged exports read line by line, whatever the size of a commit.

A line of a patch means something only together with lines before it: the hunk
that numbers it, the file, the commit. So every line is given the last header of
each kind, first within its block of the file, then, where the block holds none,
from the blocks before (:mod:`keysieve.sources.pieces`). Line numbers are
differences of a running count of the lines on the new side, which is summed over
blocks as well. A commit, a file or a hunk may reach over any number of blocks.

Two things cannot be told from a line alone. ``--- `` and ``+++ `` name a file
before its first hunk and are content after it; in a block that begins between
headers, that is left open until the last header of the blocks before is known.

Only headers and the lines worth a closer look keep their text when lines are
brought into order; of all others, only the count moves. What is written in
between is headers, and those lines encrypted with a key that the plan alone holds.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.functions.joins import salted_lookup
from keysieve.functions.text import as_characters, from_characters
from keysieve.sources.patches import HUNK, REPO, iso_date, repo_of, with_paths
from keysieve.sources.pieces import BLOCK, FILE, ROW, last_before, read_pieces, so_far, sum_before, within
from keysieve.sources.scratch import materialized

# How lines of an export begin.
COMMIT, DIFF, GONE = "commit ", "diff --git ", "deleted file mode"
AUTHOR, DATE = "Author:", "^(?:Author)?Date: "
OLD, NEW = "--- ", "+++ "
HEADERS = ("commit", "diff", "hunk")
NAMES = ("old", "new")
LASTING = ("commit", "author", "date", "diff", "gone", "hunk")


@dataclass(frozen=True)
class Export:
    """``added`` as of :func:`keysieve.sources.patches.added_lines`; ``files`` one row per file of a commit."""

    added: DataFrame
    files: DataFrame


def _kind(value: Column) -> Column:
    return (
        F.when(F.startswith(value, F.lit(COMMIT)) & value.rlike("^commit [0-9a-f]{40,64}\\b"), "commit")
        .when(F.startswith(value, F.lit(DIFF)), "diff")
        .when(F.startswith(value, F.lit("@@ ")) & value.rlike(HUNK), "hunk")
        .when(F.startswith(value, F.lit(OLD)), "old")
        .when(F.startswith(value, F.lit(NEW)), "new")
        .when(F.startswith(value, F.lit(AUTHOR)), "author")
        .when(value.rlike(DATE), "date")
        .when(F.startswith(value, F.lit(GONE)), "gone")
    )


def _at(state: str) -> Column:
    return F.col(f"{state}.at")


def _later(one: Column, *others: Column) -> Column:
    """True if a place is there and after all the others that are."""
    test = one.isNotNull()
    for other in others:
        test = test & (other.isNull() | (one > other))
    return test


def _in_order(pieces: DataFrame, worth: Callable[[Column], Column]) -> DataFrame:
    """Lines with the last header of each kind in their block; lines without a role are left out."""
    value = F.col("value")
    first = F.substring(value.cast("binary"), 1, 1)
    added = first == F.lit(b"+")
    kind = _kind(value)
    text = F.when(kind.isNotNull() | (added & worth(value)), value)
    thin = pieces.select(
        FILE, BLOCK, ROW, repo_of(pieces, F.col("_file_name")).alias(REPO), kind.alias("kind"), text.alias("text"),
        ((value == "") | added | (first == F.lit(b" "))).cast("long").alias("_new_side"), (added & text.isNotNull()).alias("_added"),
    )
    counted = thin.withColumn("_count", F.sum("_new_side").over(so_far()))
    at = F.struct(BLOCK, ROW).alias("at")
    seen = F.struct(at, F.col("text"), F.col("_count").alias("count"))
    states = counted.select(
        FILE, BLOCK, ROW, REPO, "kind", "text", "_added", "_count",
        F.lead(ROW).over(within()).isNull().alias("_closes"),
        *(F.last(F.when(F.col("kind") == k, seen), ignorenulls=True).over(so_far()).alias(k) for k in LASTING),
    )
    opened = F.coalesce(*(_at(k) for k in HEADERS)).isNull()
    preamble = _later(_at("diff"), _at("commit"), _at("hunk"))
    named = F.struct(at, F.col("text"), F.col("_count").alias("count"))
    for name in NAMES:
        for state, test in ((f"{name}_sure", preamble), (f"{name}_open", opened)):
            this = F.when((F.col("kind") == name) & test, named)
            states = states.withColumn(state, F.last(this, ignorenulls=True).over(so_far()))
    return states.filter(F.col("_closes") | F.col("_added") | F.col("kind").isin("diff", "gone", *NAMES))


def _handed(closing: DataFrame) -> DataFrame:
    """What each block is handed: the last headers and the count of the blocks before it."""
    name_states = [f"{n}_{s}" for n in NAMES for s in ("sure", "open")]
    counted = closing.select(FILE, BLOCK, *LASTING, *name_states, sum_before(F.col("_count")).alias("_before"), "_count")
    own_hunk = F.when(F.col("hunk").isNotNull(), F.col("hunk").withField("count", F.col("hunk.count") + F.col("_before")))
    counted = counted.withColumn("hunk", own_hunk)
    handed = counted.select(
        FILE, BLOCK, "_before", *name_states, *(last_before(F.col(k)).alias(f"in_{k}") for k in LASTING)
    )
    within_preamble = _later(_at("in_diff"), _at("in_commit"), _at("in_hunk")).alias("_in_preamble")
    handed = handed.select("*", within_preamble)
    for name in NAMES:
        own = F.coalesce(F.col(f"{name}_sure"), F.when(F.col("_in_preamble"), F.col(f"{name}_open")))
        handed = handed.withColumn(f"_own_{name}", own)
    return handed.select(
        FILE, BLOCK, "_before", "_in_preamble", *(f"in_{k}" for k in LASTING),
        *(last_before(F.col(f"_own_{n}")).alias(f"in_{n}") for n in NAMES),
    )


def _text_of(state: str, pattern: str) -> Column:
    text = F.col(f"{state}.text")
    found = F.regexp_extract(as_characters(text), pattern, 1)
    return F.nullif(from_characters(found, ~F.is_valid_utf8(text)), F.lit(""))


def _preamble() -> Column:
    """The lines that name the file, put together again."""
    lines = [F.substr(F.col("diff.text"), F.lit(len(DIFF) + 1))]
    lines += [F.when(_later(_at(n), _at("diff")), F.concat(F.lit("\n"), F.col(f"{n}.text"))) for n in ("old", "new", "gone")]
    return F.concat(*(F.coalesce(line, F.lit("")) for line in lines))


def read_export(spark: SparkSession, location: str, worth: Callable[[Column], Column] | None = None) -> Export:
    """The added lines and the files of ``git log -p`` or ``git diff --staged`` output, a file or ``repo=`` folder each.

    ``worth`` may leave added lines out before they are brought into order: it gets
    the line with its sign and must be true for every line that matters. Lines
    number as in :func:`keysieve.sources.patches.added_lines`; a carriage return is
    kept. ``seq`` is the place of the line, in the order of the export. The export
    is read once, when this function is called.
    """
    key = F.lit(secrets.token_bytes(32))
    ordered = _in_order(read_pieces(spark, location, "\n"), worth or (lambda line: F.lit(True)))
    line = F.when(F.col("_added"), F.aes_encrypt(F.col("text").cast("binary"), key))
    ordered = materialized(ordered.withColumn("_line", line).drop("text"), "export-lines")
    handed = _handed(ordered.filter("_closes"))
    # no order is needed from here on: blocks are few, and a task with two of them would keep the others waiting
    rows = salted_lookup(ordered, handed, [FILE, BLOCK], [ROW])
    for state in LASTING:
        own = F.col(state)
        if state == "hunk":
            own = F.when(own.isNotNull(), own.withField("count", F.col("hunk.count") + F.col("_before")))
        rows = rows.withColumn(state, F.coalesce(own, F.col(f"in_{state}")))
    for name in NAMES:
        own = F.coalesce(F.col(f"{name}_sure"), F.when(F.col("_in_preamble"), F.col(f"{name}_open")))
        rows = rows.withColumn(name, F.coalesce(own, F.col(f"in_{name}")))
    in_file = _later(_at("diff"), _at("commit"))

    def of_commit(state: str, pattern: str) -> Column:
        return F.when(_later(_at(state), _at("commit")) & _at("commit").isNotNull(), _text_of(state, pattern))

    placed = rows.filter(in_file).select(
        REPO,
        F.struct(FILE, BLOCK, ROW).alias("seq"),
        F.struct(F.col(FILE), _at("diff").alias("at")).alias("_diff"),
        F.regexp_extract(F.col("commit.text"), "^commit ([0-9a-f]{40,64})", 1).alias("commit_sha"),
        of_commit("author", "^Author: *(.*?) *<").alias("commit_author"),
        of_commit("date", "(?d)^(?:Author)?Date: +(.+?) *$").alias("_date"),
        _preamble().alias("_preamble"),
        (F.col("_before") + F.col("_count") - F.col("hunk.count")).alias("_nth"),
        F.col("hunk.text").alias("_hunk"),
        _later(_at("hunk"), _at("diff")).alias("_in_hunk"),
        "_added", "_line",
    )
    placed = placed.withColumns({"_latin": ~F.is_valid_utf8("_preamble"), "_preamble": as_characters(F.col("_preamble"))})
    date = F.coalesce(iso_date(F.col("_date")), "_date")
    placed = with_paths(placed).withColumn("commit_date", date)
    length = F.nullif(F.regexp_extract("_hunk", HUNK, 2), F.lit("")).cast("long")
    inside = F.col("_added") & F.col("_in_hunk") & (F.col("_nth") <= F.coalesce(length, F.lit(1)))
    text = F.aes_decrypt("_line", key)
    lines = placed.filter(inside).select(
        F.coalesce("new_path", F.lit("")).alias("path"),
        (F.regexp_extract("_hunk", HUNK, 1).cast("long") + F.col("_nth") - 1).cast("int").alias("line_no"),
        F.substring(text, 2, 1 << 30).cast("string").alias("line"),
        "seq",
        F.nullif("commit_sha", F.lit("")).alias("commit_sha"),
        "commit_author",
        "commit_date",
        REPO,
    )
    # computed once a row: whatever uses a column often does not repeat how it came about
    added = lines.select(F.explode(F.array(F.struct(*lines.columns))).alias("row")).select("row.*")
    # a file's names are complete at the last line that names it
    last = F.max_by(F.struct("old_path", "new_path"), "seq")
    files = placed.filter(~F.col("_in_hunk")).groupBy(REPO, "_diff").agg(last.alias("names"), F.first("commit_sha").alias("commit_sha"))
    return Export(added, files.select(REPO, F.nullif("commit_sha", F.lit("")).alias("commit_sha"), "names.old_path", "names.new_path"))
