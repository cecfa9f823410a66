"""Patches: history exports and staged diffs as tables, and the lines they add.

``patch_files`` has one row per file of a commit: ``seq, commit_sha, author,
commit_date, old_path, new_path, patch``, and ``repo`` if several repositories
are read together. The newest commit has the lowest ``seq``; a staged diff has
null commit columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.functions.text import LATIN, as_characters, from_characters

REPO = "repo"
# Escapes in quoted names, besides the backslash and the quotation mark.
ESCAPES = {"a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r"}
HUNK = "^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@"


def touched_path() -> Column:
    """The file a patch is about: its new name, or the old one if it was deleted."""
    return F.coalesce(F.nullif("new_path", F.lit("")), F.nullif("old_path", F.lit("")))


def files_touched(patch_files: DataFrame) -> DataFrame:
    """One row: distinct paths in the patches, whether or not they add lines.

    The same path in another repository is another file.
    """
    file = touched_path()
    if REPO in patch_files.columns:
        file = F.when(file.isNotNull(), F.struct(F.col(REPO), file.alias("path")))
    return patch_files.agg(F.count_distinct(file).alias("files_scanned"))


def added_lines(patch_files: DataFrame) -> DataFrame:
    """``(path, line_no, line, seq, commit_sha, commit_author, commit_date)``, and ``repo`` if given.

    Line numbers count in the new file: added and context lines advance, and
    the header of a hunk says how many there are. So the numbering needs no
    window, and nothing after a hunk's last line can be mistaken for content.
    A carriage return is kept.
    """
    commit = F.nullif("commit_sha", F.lit("")).alias("commit_sha")
    named = F.col("commit_sha") != ""
    repo = [REPO] if REPO in patch_files.columns else []
    hunks = patch_files.select(
        *repo,
        F.coalesce("new_path", F.lit("")).alias("path"),
        "seq",
        commit,
        F.when(named, F.col("author")).alias("commit_author"),
        F.when(named, F.col("commit_date")).alias("commit_date"),
        (~F.is_valid_utf8("patch")).alias("_latin"),
        F.explode(F.split(as_characters(F.col("patch")), "(?md)^(?=@@ -)")).alias("_hunk"),
    ).filter(F.col("_hunk").rlike(HUNK))
    carried = (*repo, "path", "seq", "commit_sha", "commit_author", "commit_date", "_latin")
    start = F.regexp_extract("_hunk", HUNK, 1).cast("int")
    length = F.nullif(F.regexp_extract("_hunk", HUNK, 2), F.lit("")).cast("int")
    body = F.split("_hunk", "\n")
    body = F.slice(body, F.lit(2), F.size(body))
    new_side = F.filter(body, lambda line: (line == "") | F.substring(line, 1, 1).isin("+", " "))
    sized = hunks.select(
        *carried,
        start.alias("_start"),
        F.slice(new_side, F.lit(1), F.coalesce(length, F.lit(1))).alias("_lines"),
    )
    numbered = sized.select(*carried, "_start", F.posexplode("_lines").alias("_at", "_line"))
    return numbered.filter(F.startswith("_line", F.lit("+"))).select(
        "path",
        (F.col("_start") + F.col("_at")).alias("line_no"),
        from_characters(F.substr("_line", F.lit(2)), F.col("_latin")).alias("line"),
        "seq",
        "commit_sha",
        "commit_author",
        "commit_date",
        *repo,
    )


def unquoted(name: Column, latin: Column) -> Column:
    """A name as git prints it, as bytes: quoted ones hold escapes, three octal digits for a byte.

    ``latin`` says that the text is one character per byte.
    """
    inner = F.regexp_extract(name, '(?s)^"(.*)"\\t?$', 1)
    parts = F.regexp_extract_all(inner, F.lit('(?s)(\\\\[0-7]{3}|\\\\.|[^\\\\]+)'), 1)
    letters = F.create_map(*(F.lit(x) for pair in ESCAPES.items() for x in pair))

    def plain(text: Column) -> Column:
        return F.when(latin, F.encode(text, LATIN)).otherwise(text.cast("binary"))

    def part_bytes(part: Column) -> Column:
        escaped = F.substr(part, F.lit(2))
        octal = F.unhex(F.lpad(F.conv(escaped, 8, 16), 2, "0"))
        letter = F.coalesce(F.try_element_at(letters, escaped), escaped)
        return (
            F.when(~F.startswith(part, F.lit("\\")), plain(part))
            .when(F.length(escaped) == 3, octal)
            .otherwise(plain(letter))
        )

    whole = F.aggregate(F.transform(parts, part_bytes), F.lit(b""), lambda a, b: F.concat(a, b))
    bare = plain(F.when(F.contains(name, F.lit("\t")), F.regexp_replace(name, "\\t$", "")).otherwise(name))
    return F.when(F.startswith(name, F.lit('"')), whole).otherwise(bare).cast("string")


def _path(name: Column) -> Column:
    """``a/src/x.go`` or ``b/src/x.go`` without its prefix; /dev/null is no path."""
    bare = F.when(F.substring(name, 1, 2).isin("a/", "b/"), F.substr(name, F.lit(3))).otherwise(name)
    return F.when(bare != "/dev/null", bare)


def with_paths(files: DataFrame) -> DataFrame:
    """Adds the old and the new path that the lines of a file before its first hunk name.

    ``_preamble`` begins after ``diff --git``; ``_latin`` says that it is one character
    per byte. In steps, each a column that the next one uses several times: as one
    expression, a name would be looked for and unquoted again for each of these uses.
    """
    quoted = '"(?:[^"\\\\]|\\\\.)*"'
    header_names = f"\\A({quoted}|a/.*?) ({quoted}|b/.*?)(?:\\n|\\z)"
    sides = (("old", "---", 1), ("new", "\\+\\+\\+", 2))
    marked = files.withColumns({f"_{side}": F.regexp_extract("_preamble", f"(?md)^{sign} (.+)$", 1) for side, sign, _ in sides})
    gone = F.contains("_preamble", F.lit("\ndeleted file mode"))
    names = {}
    for side, _, group in sides:
        header = F.regexp_extract("_preamble", header_names, group)
        names[f"_{side}"] = F.when(F.col(f"_{side}") != "", F.col(f"_{side}")).otherwise(F.when(~gone, header) if side == "new" else header)
    named = marked.withColumns(names)
    bare = named.withColumns({f"_{side}": unquoted(F.col(f"_{side}"), F.col("_latin")) for side, _, _ in sides})
    return bare.withColumns({f"{side}_path": _path(F.col(f"_{side}")) for side, _, _ in sides}).drop("_old", "_new")


def split_commits(commits: DataFrame) -> DataFrame:
    """Patch files from ``(seq, text)``, one commit (or one staged diff) per row.

    ``text`` is the output of ``git log -p`` or ``git diff --staged``; a ``repo``
    column is carried along.
    """
    repo = [REPO] if REPO in commits.columns else []
    viewed = commits.select(
        *repo,
        F.col("seq").alias("_commit"),
        (~F.is_valid_utf8("text")).alias("_latin"),
        F.concat(F.lit("\n"), as_characters(F.col("text"))).alias("_text"),
    )
    header = F.substring_index("_text", "\ndiff --git ", 1)
    sha = F.regexp_extract(header, "\\A\ncommit ([0-9a-f]{40,64})\\b", 1)
    author = F.regexp_extract(header, "(?md)^Author: *(.*?) *<", 1)
    date = F.trim(F.regexp_extract(header, "(?md)^(?:Author)?Date: +(.+)$", 1))
    # computed once a commit: what a column is made of is not repeated for each of its uses
    read = F.struct(sha.alias("commit_sha"), author.alias("author"), date.alias("commit_date"))
    commits = viewed.select("*", F.explode(F.array(read)).alias("_read")).select(*viewed.columns, "_read.*")
    parts = F.transform(F.array(F.split("_text", "\ndiff --git ")), lambda p: F.slice(p, F.lit(2), F.size(p)))[0]
    files = commits.select(
        *repo,
        "_commit",
        "_latin",
        *(F.nullif(name, F.lit("")).alias(name) for name in ("commit_sha", "author", "commit_date")),
        F.posexplode(parts).alias("_at", "_file"),
    ).withColumn("_preamble", F.substring_index("_file", "\n@@ -", 1))
    latin = F.col("_latin")
    return with_paths(files).select(
        *repo,
        F.struct("_commit", "_at").alias("seq"),
        "commit_sha",
        from_characters(F.col("author"), latin).alias("author"),
        F.coalesce(iso_date(F.col("commit_date")), "commit_date").alias("commit_date"),
        "old_path",
        "new_path",
        from_characters(F.substr("_file", F.length("_preamble") + 2), latin).alias("patch"),
    )


def iso_date(text: Column) -> Column:
    """``Mon Jan 2 15:04:05 2006 -0700`` as RFC 3339 text in its own offset."""
    pattern = "^\\w{3} (\\w{3}) +(\\d{1,2}) (\\d{2}:\\d{2}:\\d{2}) (\\d{4}) ([+-]\\d{2})(\\d{2})$"

    def part(group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    months = "JanFebMarAprMayJunJulAugSepOctNovDec"
    month = F.floor((F.instr(F.lit(months), part(1)) + 2) / 3)
    zone = F.concat(part(5), F.lit(":"), part(6))
    return F.when(
        text.rlike(pattern),
        F.concat(
            part(4), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
            F.lpad(part(2), 2, "0"), F.lit("T"), part(3),
            F.when(zone == "+00:00", "Z").otherwise(zone),
        ),
    )


def _records(spark: SparkSession, location: str, start: str) -> DataFrame:
    """``(repo, seq, text)``: text files cut where a line begins with ``start``.

    Spark splits files at record ends, so one large export is still read by
    many tasks. ``seq`` orders the records of a file as they were written;
    ``repo`` is the file's name without its ending, or that of a folder ``repo=...``.
    """
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    records = spark.read.option("lineSep", "\n" + start).text(location)
    text = F.when(F.startswith("value", F.lit(start)), F.col("value")).otherwise(
        F.concat(F.lit(start), F.col("value"))
    )
    return records.select(repo_of(records, F.col("_metadata.file_name")).alias(REPO), seq.alias("seq"), text.alias("text"))


def repo_of(exports: DataFrame, file_name: Column) -> Column:
    """The repository of an export: a folder ``repo=...``, or the file's name without its ending."""
    return F.col(REPO).cast("string") if REPO in exports.columns else F.regexp_replace(file_name, "\\.[^.]*$", "")


def read_history(spark: SparkSession, location: str) -> DataFrame:
    """Patch files from exports of ``git log -p -U0``, one text file per repository."""
    return split_commits(_records(spark, location, "commit "))


def read_staged(spark: SparkSession, location: str) -> DataFrame:
    """Patch files from ``git diff --staged -U0`` output, one text file per repository."""
    return split_commits(_records(spark, location, "diff --git "))
