"""Texts with bytes that are not UTF-8: every operator reads them with U+FFFD in their place."""

import pytest
from pyspark.sql import functions as F

from keysieve.llm import bpe, decontam, langid, license, lines, neardup, pii, quality
from keysieve.llm.queries import tokenizer_path

BROKEN = "cast(unhex(concat(hex('Released words mail a@b.org '), 'FFC3', hex(' end of the text here'))) AS string)"
SHOWN = "Released words mail a@b.org �� end of the text here"


@pytest.fixture
def pair(spark):
    """The same text twice, once with broken bytes and once with what stands for them."""
    rows = spark.range(2).withColumn("text", F.when(F.col("id") == 0, F.expr(BROKEN)).otherwise(SHOWN))
    return rows.select(F.col("id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"))


def same(frame, *names):
    rows = [tuple(r[n] for n in names) for r in frame.orderBy(frame.columns[0]).collect()]
    assert len(rows) == 2 and rows[0] == rows[1]


def test_operators_read_them(spark, pair):
    same(bpe.digests(bpe.encode(pair, tokenizer_path())), "n_tokens", "ids_sha256", "decoded_sha256")
    same(pii.scan(pair), "spans")
    assert pii.redact(pair).count() == 2
    same(quality.features(pair), "x")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert quality.keep_good(pair, labels).count() <= 2
    same(langid.identify(pair, langid.fit(pair)), "lang_pred", "score")
    same(neardup.components_of(pair, neardup.Near(words=2, percent=80)), "n_shingles")
    assert license.scan(license.document_files(pair)).count() == 2
    assert lines.digests(lines.deduplicated(pair.select("doc_id", "text"))).count() == 2
    items = spark.createDataFrame([("i", "end of the text here")], "item_id string, text string")
    assert decontam.contamination(pair, items).count() == 2
