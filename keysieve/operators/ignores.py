"""Ignore files of many repositories at once: patterns as a table.

A pattern is filed under the longest path segment that it spells out; a path looks
up its own segments within its repository, so it meets only the patterns that may
match, and those without any such segment. For each of a path's folders and the
path itself the last pattern that matches decides, as in
:class:`keysieve.functions.globs.PathMatcher`; the patterns that hold everywhere
stay constants and decide where no pattern of the repository does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.functions.globs import PathMatcher, glob_pattern, ignore_lines, normal_path, parse_pattern, path_matcher
from keysieve.functions.joins import SALTS
from keysieve.operators.suppress import REPO
from keysieve.sources.scratch import materialized

META = frozenset("*?[]{}\\")
PATTERNS = "repo string, ordinal long, negated boolean, key string, file_regex string, folder_regex string, problem string"
PATTERNS_ARROW = pa.schema(
    [
        ("repo", pa.string()), ("ordinal", pa.int64()), ("negated", pa.bool_()), ("key", pa.string()),
        ("file_regex", pa.string()), ("folder_regex", pa.string()), ("problem", pa.string()),
    ]
)


def key_segment(glob: str) -> str:
    """The longest segment that every path matched by the glob holds; empty if there is none for certain."""
    if "{" in glob or "\\" in glob:  # alternatives may span segments
        return ""
    return max((s for s in glob.split("/") if s and not META & set(s)), key=len, default="")


def _compiled(repo: str, ordinal: int, line: str) -> dict | None:
    kept = ignore_lines(line)
    glob, negated = parse_pattern(kept[0]) if kept else ("", False)
    if not glob:
        return None
    row = {"repo": repo, "ordinal": ordinal, "negated": negated, "key": key_segment(glob), "problem": None}
    try:
        row["file_regex"] = glob_pattern(glob)
        folders = [glob] + ([glob[: -len("/**")]] if glob.endswith("/**") else [])
        row["folder_regex"] = "|".join(glob_pattern(g) for g in folders)
    except ValueError as problem:
        row["problem"] = f"repository {repo!r}: {problem}"
    return row


def _compile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = (_compiled(r["repo"], r["ordinal"], r["line"] or "") for r in batch.to_pylist())
        yield pa.RecordBatch.from_pylist([r for r in rows if r], PATTERNS_ARROW)


def ignore_patterns(lines: DataFrame) -> DataFrame:
    """The patterns of ``(repo, ordinal, line)``, the lines of ignore files in their order; a malformed one is an error."""
    found = materialized(lines.select("repo", F.col("ordinal").cast("long"), "line").mapInArrow(_compile, PATTERNS), "ignore-patterns")
    bad = found.filter("problem IS NOT NULL").orderBy("repo", "ordinal").first()
    if bad:
        raise ValueError(bad["problem"])
    return found.drop("problem")


def _nodes(path: Column) -> Column:
    """The folders above a path from the top, then the path itself."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))


def last_matches(files: DataFrame, patterns: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """``(repo, path, matched)``: for paths that any pattern of their repository matches, by depth whether the last one re-includes.

    A repository may hold a large share of all files: its paths are spread over
    partitions and its patterns repeated.
    """
    paths = files.select(REPO, "path").distinct().withColumn("_path", normal_path(F.col("path")))
    paths = paths.filter(~F.col("_path").isin("", ".")).withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int"))
    size = F.size(F.split("_path", "/"))
    nodes = paths.select(REPO, "path", "_salt", size.alias("_size"), F.posexplode(_nodes(F.col("_path"))).alias("depth", "node"))
    keys = F.array_distinct(F.concat(F.array(F.lit("")), F.split("node", "/")))
    tried = nodes.withColumn("key", F.explode(keys))
    repeated = patterns.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = tried.join(repeated, [REPO, "key", "_salt"])
    is_file = F.col("depth") == F.col("_size") - 1
    hit = F.rlike(F.col("node"), F.when(is_file, F.col("file_regex")).otherwise(F.col("folder_regex")))
    last = met.filter(hit).groupBy(REPO, "path", "depth").agg(F.max_by("negated", "ordinal").alias("negated"))
    return last.groupBy(REPO, "path").agg(F.map_from_entries(F.collect_list(F.struct("depth", "negated"))).alias("matched"))


def with_ignored(files: DataFrame, patterns: DataFrame, *, everywhere: PathMatcher | None = None, salts: int = SALTS) -> DataFrame:
    """Adds ``excluded_by``: the topmost folder of a path that its repository's patterns exclude, else the path itself, else null.

    ``files`` has ``repo`` and ``path``; every row is kept. ``everywhere`` comes
    before the patterns of every repository, the default globs unless given. An
    excluded folder hides what is below it, re-included or not.
    """
    matcher = path_matcher() if everywhere is None else everywhere
    found = last_matches(files, patterns, salts=salts)
    placed = files.join(found, [REPO, "path"], "left")
    path = normal_path(F.col("path"))
    nodes = _nodes(path)

    def excluded(node: Column, depth: Column, folder: bool) -> Column:
        own = F.try_element_at("matched", depth)
        return F.when(own.isNotNull(), ~own).otherwise(matcher._last_match(node, folder))

    above = F.slice(nodes, F.lit(1), F.size(nodes) - 1)
    marked = F.transform(above, lambda node, i: F.when(excluded(node, i, True), node))
    topmost = F.get(F.filter(marked, lambda node: node.isNotNull()), 0)
    itself = F.when(excluded(path, F.size(nodes) - 1, False), path)
    return placed.withColumn("excluded_by", F.coalesce(topmost, itself)).drop("matched")
