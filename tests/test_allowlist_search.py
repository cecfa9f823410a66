from pyspark.sql import functions as F

from keysieve.functions.regex import portable
from keysieve.operators.detect import any_of

PATTERNS = (".+EXAMPLE$", ".*EXAMPLE", ".+.*x$", ".+", ".*", ".+|^$", ".*|x", "a.+b", ".+?b", ".*?b$", ".{2}b", "\\.+b", "(?s).+b", "(.+)b")
TEXTS = ("", "x", "ab", "xEXAMPLE", "EXAMPLE", "\nEXAMPLE", "aEXAMPLE\n", "x\nyEXAMPLE", "..b", "a\nb", "é b", "aéx", "b", "\n", "\nx")


def test_patterns_find_something_in_the_same_texts(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [F.col("t").rlike(any_of([p])).alias(f"got{n}") for n, p in enumerate(PATTERNS)]
    want = [F.col("t").rlike(f"(?:{portable(p)})").alias(f"want{n}") for n, p in enumerate(PATTERNS)]
    for row in frame.select("t", *got, *want).collect():
        for n, pattern in enumerate(PATTERNS):
            assert row[f"got{n}"] == row[f"want{n}"], (pattern, row.t)


def test_a_search_does_not_repeat_at_every_character():
    assert any_of([".+EXAMPLE$"]) == any_of([".EXAMPLE$"]) and any_of([".*EXAMPLE$"]) == any_of(["EXAMPLE$"])
