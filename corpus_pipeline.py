"""The training corpus in five stages, from raw documents to tokens.

Each stage gets the documents that the one before has kept and returns documents
with the same columns; the last returns tokens. Every stage is written as Parquet
in the shared scratch folder and read again, so a lost executor repeats a part of
one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import bpe, decontam, lines, neardup, quality
from keysieve.llm.common import fresh, table, written
from keysieve.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document holds; ``n_chars`` follows the text."""
    names = docs.columns
    kept = lines.deduplicated(docs, counts=(fresh(docs, "_n_lines"), fresh(docs, "_n_dropped")))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*names)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles."""
    return neardup.keep_one(docs, neardup.Near(words=5, percent=80))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of what is left; ids packed as little-endian 32-bit integers."""
    return bpe.encode(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality", good_quality),
    ("line dedup", distinct_lines),
    ("near duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("tokens", tokens),
]

#: A fitted classifier and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
