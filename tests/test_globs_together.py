import random

from pyspark.sql import functions as F

from keysieve.functions.globs import DEFAULT_EXCLUDES, GlobError, any_glob, glob_pattern, path_matcher

PARTS = ("**/", "/**", "**", "*", "?", "/", "a", "b", ".", "[!a]", "{a,b/**}", "{a,**/b}", "\\*", "\\/", "**/*", "a/**")
PATHS = ("a/vendor/b", "vendor", "vendored", "x/vendor", "dist", "a/dist/", "a/x.min.js", "x.min.js/y", "go.sum", "a/go.sum/b", ".map", "a\nb/build/\n")


def some_globs(dice, count):
    found = []
    while len(found) < count:
        glob = "".join(dice.choice(PARTS) for _ in range(dice.randint(1, 5)))
        try:
            glob_pattern(glob)
        except GlobError:
            continue
        found.append(glob)
    return found


def test_globs_together_match_what_each_matches(spark):
    dice = random.Random(11)
    sets = [list(DEFAULT_EXCLUDES), *(some_globs(dice, dice.randint(1, 4)) for _ in range(40))]
    paths = [*PATHS, *("".join(dice.choice("aab./\n*é") for _ in range(dice.randint(0, 7))) for _ in range(300))]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [F.col("p").rlike(any_glob(globs)).alias(f"got{n}") for n, globs in enumerate(sets)]
    want = [F.col("p").rlike("|".join(glob_pattern(g) for g in globs)).alias(f"want{n}") for n, globs in enumerate(sets)]
    for row in frame.select("p", *got, *want).collect():
        assert [row[f"got{n}"] for n in range(len(sets))] == [row[f"want{n}"] for n in range(len(sets))], row.p


def test_default_globs_read_a_path_once(spark):
    frame = spark.createDataFrame([("a/b",)], "path string").select(path_matcher().excluded_by(F.col("path")).alias("by"))
    assert "[\\s\\S]*" not in frame._jdf.queryExecution().optimizedPlan().toString()
