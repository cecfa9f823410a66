"""Ignore files of several repositories as a table, against one matcher per repository."""

import random

import pytest
from pyspark.sql import functions as F

from keysieve.functions.globs import path_matcher
from keysieve.operators.ignores import ignore_patterns, key_segment, with_ignored

FILES = {
    "one": ["# comment", "", "  **/*.log ", "!keep/**/*.log", "docs/**", "!docs/index.md", "src/[a-c]*/gen", "a/**/b.txt"],
    "two": ["!**/vendor/**", "vendor/x.go", "{build,out}/**", "?.tmp"],
    "three": [],
    "four": ["**", "!src/**", "!*.md", "**/deep/**"],
}
PARTS = ["src", "docs", "vendor", "keep", "a", "b", "build", "out", "deep", "gen", "alpha", "node_modules"]
ENDS = ["x.go", "index.md", "a.log", "b.txt", "t.tmp", "app.min.js", "gen", "go.sum", "ü.md"]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(repo, n, line) for repo, text in FILES.items() for n, line in enumerate(text)]
    return spark.createDataFrame(rows, "repo string, ordinal int, line string")


@pytest.mark.parametrize("defaults", [True, False])
def test_same_as_a_matcher_per_repository(spark, lines, defaults):
    dice = random.Random(1)
    paths = sorted({"/".join([*dice.choices(PARTS, k=dice.randrange(0, 4)), dice.choice(ENDS)]) for _ in range(400)}) + ["./src/x.go", "a\\b.txt", "", "."]
    rows = [(repo, path, n) for n, path in enumerate(paths) for repo in [*FILES, "unknown"]]
    files = spark.createDataFrame(rows + rows[:7], "repo string, path string, n int")
    everywhere = None if defaults else path_matcher((), defaults=False)
    found = with_ignored(files, ignore_patterns(lines), everywhere=everywhere)
    assert found.columns == [*files.columns, "excluded_by"] and found.count() == len(rows) + 7
    got = {(r.repo, r.path): r.excluded_by for r in found.collect()}
    for repo in [*FILES, "unknown"]:
        matcher = path_matcher(FILES.get(repo, ()), defaults)
        want = files.filter(F.col("repo") == repo).select("path", matcher.excluded_by(F.col("path")).alias("by")).distinct()
        differing = [(r.path, r.by, got[repo, r.path]) for r in want.collect() if got[repo, r.path] != r.by]
        assert not differing, (repo, differing[:3])
    assert len({by for by in got.values()}) > 20


def test_a_malformed_pattern_names_its_repository(spark):
    with pytest.raises(ValueError, match="'r'"):
        ignore_patterns(spark.createDataFrame([("r", 0, "a/[b")], "repo string, ordinal int, line string"))


def test_no_patterns(spark):
    files = spark.createDataFrame([("r", "vendor/x")], "repo string, path string")
    none = ignore_patterns(spark.createDataFrame([], "repo string, ordinal int, line string"))
    assert [r.excluded_by for r in with_ignored(files, none).collect()] == ["vendor"]


def test_key_segments():
    assert [key_segment(g) for g in ("**/vendor/**", "src/[a]/generated", "*.log", "{a,b/c}/d", "a\\*/b", "x/y")] == [
        "vendor", "generated", "", "", "", "x",
    ]
