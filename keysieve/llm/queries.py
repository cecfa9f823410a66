"""The operators as registered queries over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import bpe, centroids, decontam, divergence, html, langid, license, lines, neardup, packing, pii, quality, topk
from keysieve.llm.common import held_out, table
from keysieve.llm.oracles import ORACLES

QUERY_IDS = 50


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components_of(table(spark, sf_dir, "documents"), neardup.Near(words=2, percent=80))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(license.document_files(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("key", "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents, langid.fit(documents))
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return decontam.digests(decontam.per_row(documents, decontam.contamination(documents, table(spark, sf_dir, "benchmark"))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.scan(table(spark, sf_dir, "documents")))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(vectors, vectors.where(F.col("id") % QUERY_IDS == 0), 5)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return centroids.digests(centroids.cluster(vectors))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html": op1_html,
    "op2_minhash": op2_minhash,
    "op3_license": op3_license,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_lines": op6_lines,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_topk": op10_topk,
    "op11_packing": op11_packing,
    "op12_centroids": op12_centroids,
    "op13_divergence": op13_divergence,
}
