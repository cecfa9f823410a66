"""The audit against brute force with exact integers, on documents with every kind of odd row."""

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keysieve.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(rows, least=10, top=10):
    """Every term of every group, kept terms alone; rows are ``(text, lang, source)``."""
    counts, holders, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in ((t or "", la or "", so or "") for t, la, so in rows):
        words = plain_terms(text)
        counts[lang, source].update(words)
        holders.update((lang, w) for w in set(words))
        groups.add((lang, source))
    out = []
    for lang in {la for la, _ in groups}:
        vocabulary = [w for (la, w), n in holders.items() if la == lang and n >= least]
        names = [so for la, so in groups if la == lang]

        def shares(count):
            total = sum(count[w] for w in vocabulary)
            return {w: 1 + 10**9 * (count[w] + 2) // (total + 2 * len(vocabulary)) for w in vocabulary}

        own = {so: shares(counts[lang, so]) for so in names}
        all_of = shares(sum((counts[lang, so] for so in names), Counter()))

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        for so in names:
            found = [(-sum(apart(own[so][w], own[other][w]) for w in vocabulary), other.encode()) for other in names if other != so]
            out += [(lang, so, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(sorted(found), 1)]
            found = [(-apart(own[so][w], all_of[w]), w.encode()) for w in vocabulary if counts[lang, so][w] and own[so][w] > all_of[w]]
            out += [(lang, so, "term", w.decode(), -v, r) for r, (v, w) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(spark, rows, **options):
    clash = ["'x' AS n", "'y' AS term", "1 AS p", "2 AS q", "'z' AS item", "'w' AS value", "0 AS rank", "'v' AS block", "1 AS floor"]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).selectExpr("*", *clash)
    return sorted(tuple(r) for r in divergence.audit(frame, **options).collect())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("AZaz09 _@[`{\t\n-'éßИ中🙂\x7f\x80\xa0"), st.characters(exclude_categories=["Cs"]))))
def test_terms(text):
    assert [t.decode() for t in divergence.terms(text.encode())] == plain_terms(text)


def rows_of(seed, n):
    dice = random.Random(seed)
    words = ["the", "The", "house", "größe", "ТЕКСТ", "x1y", "tie", "eit", "rare", "中文", "don't", "über"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(n):
        lang = dice.choice(["en", "en", "en", "de", "", None])
        source = dice.choice(["hot", "hot", "s1", "s2", "é", "", None])
        rows.append((" ".join(dice.choices(words, k=dice.randrange(0, 30))), lang, source))
    return rows


ODD = [(None, "en", "s1"), ("", "fr", "empty"), ("one two", "fr", "few"), ("123 _-", "xx", "lone"), (None, None, None),
       ("the " * 40_000 + "End", "en", "long"), ("same text", "en", "s1"), ("same text", "en", "s1")]


@pytest.mark.parametrize("cells", [1 << 20, 16])
def test_same_as_brute_force(spark, cells):
    rows = rows_of(3, 300) + ODD
    assert found(spark, rows, block_cells=cells) == brute(rows)


def test_least_and_top(spark):
    rows = rows_of(4, 60) + ODD
    assert found(spark, rows, least=1, top=3) == brute(rows, 1, 3)
    assert found(spark, rows, least=10_000) == brute(rows, 10_000)


def test_a_task_gives_out_what_it_holds(spark, monkeypatch):
    rows = rows_of(5, 120)
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    whole = sorted(map(tuple, divergence.term_counts(frame).collect()))
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    assert sorted(map(tuple, divergence.term_counts(frame).collect())) == whole


def test_counts_beyond_long_products(spark):
    """Shares stay exact where a count times the scale is beyond 63 bits."""
    from pyspark.sql import functions as F

    n, total = 10**13 + 7, 3 * 10**13 + 1
    frame = spark.createDataFrame([(n, total, 5), (0, total, 5), (1, 1, 0)], "n long, total long, v long")
    got = [r.p for r in frame.select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 10), 1 + 10**9 * 2 // (total + 10), None]


def test_invalid_utf8_and_empty(spark):
    frame = spark.sql("SELECT cast(X'61FF62' AS string) AS text, 'en' AS lang, cast(X'FF' AS string) AS source")
    assert sorted(tuple(r) for r in divergence.audit(frame, least=1).collect()) == []
    assert {(r.source, r.term.decode()) for r in divergence.term_counts(frame).collect()} == {("�", ""), ("�", "a�b")}
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
