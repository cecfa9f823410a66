import re

import duckdb
import pytest
from pyspark.sql import functions as F

from keysieve.functions.keywords import any_pattern, folded
from keysieve.functions.regex import PatternError, parse, portable

PATTERNS = [
    r"\b(AKIA[A-Z2-7]{4})\b", r"(?i)key\W+(\w+)", r"[\w-]{3,5}", r"a.c", r"(?s)a.c", r"^x|y$", r"(?m)^x|y$",
    r"\s+", r"[^\s@]+", r"[[:alpha:]_]+[[:digit:]]*", r"(?i)[k-s]+", r"(?i:tOk)en", r"(?-i)abc", r"a{2,3}?", r"(?U)a+",
    r"\Qa.b\E+", r"\x41\x{42}\103", r"(?P<n>x)(y)?", r"(a|b)*c", r"a{,2}", r"[]a]+", r"[^]a]+", r"[a\-z]+", r"\.\*\[",
    r"(?i)straße", r"é+", r"\pL+", r"[\p{Lu}\d]+", r"\D\S\W", r"(?i)\W", r"\B\w", r"x{0}y", r"(?i)[^k]", r"\Ax|y\z",
    r"[a-c]+d", r"a*ab", r"(?:[ab]+c)+b", r"x*(?:y|x)z", r"[^@]+@", r"a?ab", r"(?:a+)+b", r"[a-c]{2,3}\b", r"(?:b+a)*b", r"\w+\b:",
    r"[\x60\"'\s;]|\\[nr]|$", r"(?i)s", r"\t|\v|\f", r"[[:^digit:]]", r"a||b", r"(|a)+b", r"(?i)(?:k)(?-i:S)",
]
SUBJECTS = [
    "éAKIA2345 AKIAWXYZ_ xAKIA2345", "Key = töken; \u212aey : v1 \u017fecret", "a\nc a\rc a\u2028c abc", "x\ny", "y\r",
    "tab\tvt\x0bff\x0cnl", "aaaa aa ab {,2} a{,2}", "a.b.b] ABC [a-z]*", "STRASSE straße \u0130\u0131 kKsS",
    "", "x", "xy yx", "\x60'\" \\n ;", "user@host:1 密é9", "a\u0085c \u2029", "bbbac aab",
]
REJECTED = [
    r"(?=a)", r"(?!a)", r"(?<=a)b", r"(?<!a)b", r"(a)\1", r"a**", r"a*+", r"(?>a)", r"a{1001}", r"a{3,2}", "(a", "a)",
    "[a", r"[z-a]", r"\y", "*a", r"(?z)a", "\\", r"\k<n>",
]


def test_java_and_python_find_what_re2_finds(spark):
    con = duckdb.connect()
    frame = spark.createDataFrame([(s,) for s in SUBJECTS], "s string").coalesce(1)
    found = frame.select(
        *(F.regexp_extract_all("s", F.lit(f"({portable(p)})"), 1).alias(f"p{i}") for i, p in enumerate(PATTERNS))
    ).collect()
    for i, pattern in enumerate(PATTERNS):
        in_python = re.compile(parse(pattern, "python").text)
        rewritten = parse(pattern, "re2").text
        for subject, row in zip(SUBJECTS, found):
            want = con.execute("SELECT regexp_extract_all(?, ?)", [subject, pattern]).fetchone()[0]
            assert con.execute("SELECT regexp_extract_all(?, ?)", [subject, rewritten]).fetchone()[0] == want
            # engines differ only in how they count empty matches
            want = [w for w in want if w]
            assert [m for m in row[i] if m] == want, (pattern, subject)
            if not in_python.match(""):  # Python alone looks again where an empty match was
                assert [m.group() for m in in_python.finditer(subject)] == want, (pattern, subject)


@pytest.mark.parametrize("pattern", REJECTED)
def test_what_re2_rejects_is_rejected(pattern):
    with pytest.raises(PatternError):
        parse(pattern)
    with pytest.raises(duckdb.Error):
        duckdb.connect().execute("SELECT regexp_matches('x', ?)", [pattern]).fetchall()


def test_a_group_name_is_used_once():
    with pytest.raises(PatternError):
        parse(r"(?P<n>a)(?P<n>b)")


def test_cutting_around_the_secret():
    cut = parse(r"(a+)://(?::(b+))@(c)").split(2)
    assert (cut.before, cut.secret, cut.after) == ("(?:a++)\\:\\/\\/\\:", "b++", "\\@(?:c)")
    assert parse(r"\b(x1)\b").split(1).bare
    assert parse("plain").split(1).secret == "plain"
    assert parse(r"(?:x(a)|y)").split(1) is None
    assert parse(r"(a)+").split(1) is None
    assert re.compile(parse(r"(?:x(a)|(y))+", "python").capture(2)).groups == 1


def test_keyword_pattern(spark):
    words = ["token", "key", "ey", "AKIA", "://", "a", "hook.s", "-----begin"]
    lines = ["the TOKEN", "\u212aEY", "ak\u0130a", "none of it", "x://y", "HOOK.S", "-----BEGIN", "", "hooks", "T0KEN"]
    frame = spark.createDataFrame([(s,) for s in lines], "s string")
    words = [w for w in words if w != "a"]
    rows = frame.select(
        "s", F.lower("s").rlike(any_pattern(words)).alias("near"), folded(F.col("s"), [w.lower() for w in words]).alias("low")
    ).collect()
    for row in rows:
        text = row.s.replace("\u0130", "i").replace("\u212a", "k").lower()
        exact = any(w.lower() in text for w in words)
        assert exact == any(w.lower() in row.low for w in words), row
        assert row.near or not exact, row
    assert not [r for r in rows if r.s in ("none of it", "", "hooks", "T0KEN") and r.near]
