from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keysieve.llm import langid
from keysieve.llm.common import held_out


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(documents, langid.fit(documents)).join(documents.select("doc_id", "lang"), "doc_id")
    row = found.where(held_out("doc_id")).agg(
        F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("accuracy"), F.min("score").alias("low"), F.max("score").alias("high")
    ).first()
    assert row.accuracy > 0.98 and row.low >= 0 and row.high <= 1


def test_odd_rows(spark, docs):
    text = {"en": "the house and the garden", "de": "das haus und der garten", "fr": "la maison et le jardin"}
    rows = [(i, f"{text[lang]} {i}", lang) for i in range(60) for lang in text]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)] + [(900, None, "en"), (901, "12 34 ...", "de"), (902, "etwas", None)]
    learned = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned.families == ["germanic", "romance"] and learned.languages == [["de", "en"], ["fr"]]
    odd = docs([(1, None), (2, ""), (3, "1 2 3 ?!"), (4, "das haus " * 20000), (4, "LA MAISON"), (None, "the garden and the house")], extra=True)
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.identify(odd, learned).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "de"), ("4", "fr"), ("None", "en")]
    nothing = langid.fit(docs([]))
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, nothing).collect()} == {("und", 0.0)}
    single = langid.fit(docs([(i, "some words here") for i in range(9)]))
    assert [r.lang_pred for r in langid.identify(docs([(1, "anything")]), single).collect()] == ["en"]
    assert langid.identify(docs([]), learned).collect() == []


def test_copies_do_not_count(spark):
    """A language of many copies of a few texts is learned, and no text is in the sample twice."""
    text = {"en": "the house and the garden", "de": "das haus und der garten", "fr": "la maison et le jardin"}
    rows = [(i, f"{text[lang]} {'abc'[i % 3]}", lang) for i in range(500) for lang in ("en", "de")]
    rows += [(i, f"{text['fr']} {chr(97 + i // 26)}{chr(97 + i % 26)}", "fr") for i in range(500)] + [(i, f"{i}", "xx") for i in range(30)]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sample = [(r.language, bytes(r.x)) for r in langid.training_rows(documents, 4).collect()]
    assert Counter(n for n, _ in sample) == {"en": 3, "de": 3, "fr": 4} and len(set(sample)) == len(sample)
    assert sorted(sample) == sorted((r.language, bytes(r.x)) for r in langid.training_rows(documents.coalesce(1), 4).collect())
    assert langid.fit(documents, 4).languages == [["de", "en"], ["fr"]]


def test_smallest_hashes(spark):
    rows = [("a", h) for h in range(-50, 50)] + [("b", h << 56) for h in range(-128, 128)] + [("c", 7)]
    found = langid.largest_hashes(spark.createDataFrame(rows, "lang string, h long"), 20)
    assert found == {"a": -31, "b": -109 << 56, "c": 7}


def test_machine_separates_with_a_margin():
    rng = np.random.default_rng(0)
    x = np.vstack((rng.normal(size=(80, 5)) + 2, rng.normal(size=(20, 5)) - 2)).astype(np.float32)
    positive = np.arange(100) < 80
    w = langid.separate(x, positive)
    assert ((np.hstack((x, np.ones((100, 1)))) @ w > 0) == positive).all()


def test_families():
    assert langid.family_of("de-AT") == langid.family_of("en") != langid.family_of("fr") == langid.family_of("ES")
    assert langid.family_of("xx") != langid.family_of("yy")
