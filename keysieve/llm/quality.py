"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (logarithms of sizes,
arcsine roots of shares), so that a normal density per class is a fair model.
Class means and covariances come from sums and sums of products that Spark adds
up over all labelled rows; the driver sees a few numbers per class. Covariances
are shrunk twice: towards the pooled one, then towards a multiple of the unit
matrix. A score is the logistic of the difference of log densities; Mahalanobis
distances use Cholesky factors that are computed once and sent along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.common import fresh, held_out, per_batch, valid_text, written

THRESHOLD = 0.3
POOLING = 0.7
SPHERING = 0.02
BATCH_ROWS = 512
STATISTICS = (
    "log_chars", "log_words", "log_word_length", "log_word_spread", "upper", "letters", "digits", "blanks", "stops",
    "symbols", "symbol_ends", "vocabulary", "distinct_pairs", "distinct_lines", "log_lines", "log_sentence",
)
UPPER, LOWER, DIGIT, BLANK, STOP, SYMBOL, BEYOND, INNER = range(8)


def byte_classes() -> np.ndarray:
    """The kind of each byte; a byte inside a character beyond ASCII is ``INNER``."""
    kinds = np.full(256, SYMBOL, dtype=np.uint8)
    kinds[0x41:0x5B] = UPPER
    kinds[0x61:0x7B] = LOWER
    kinds[0x30:0x3A] = DIGIT
    kinds[[9, 10, 11, 12, 13, 32]] = BLANK
    kinds[[ord(c) for c in ".,;:?'\"()-"]] = STOP
    kinds[0xC0:] = BEYOND
    kinds[0x80:0xC0] = INNER
    return kinds


KINDS = byte_classes()


def root(part: float, whole: float) -> float:
    return float(np.arcsin(np.sqrt(part / whole))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; those of a null text are an empty one's."""
    text = text or ""
    raw = text.encode()
    kinds = KINDS[np.frombuffer(raw, dtype=np.uint8)]
    count = np.bincount(kinds, minlength=8)
    chars = len(raw) - int(count[INNER])
    letters = int(count[UPPER] + count[LOWER] + count[BEYOND])
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    ends = int(np.count_nonzero((kinds[:-1] == SYMBOL) & (kinds[1:] == BLANK))) + int(len(raw) > 0 and kinds[-1] == SYMBOL)
    lines = text.split("\n")
    sentences = 1 + raw.count(b".") + raw.count(b"?") + raw.count(b"!")
    return [
        np.log1p(chars),
        np.log1p(n),
        np.log1p(lengths.mean() if n else 0.0),
        np.log1p(lengths.std() if n else 0.0),
        root(count[UPPER], letters),
        root(letters, chars),
        root(count[DIGIT], chars),
        root(count[BLANK], chars),
        root(count[STOP], chars),
        root(count[SYMBOL], chars),
        root(min(ends, n), n),
        np.log1p(len(set(words))) / np.log1p(n) if n else 0.0,
        root(len(set(zip(words, words[1:]))), n - 1) if n > 1 else 0.0,
        root(len(set(lines)), len(lines)),
        np.log1p(len(lines)),
        np.log1p(n / sentences),
    ]


def features(frame: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, x)``: one vector of statistics per row."""
    source = frame.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [[float(v) for v in statistics(t)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], [key, "x"])

    return source.mapInArrow(per_batch(work, BATCH_ROWS), schema)


@dataclass(frozen=True)
class Discriminant:
    """Log priors, means and inverse Cholesky factors of both classes; ``fixed`` if a class is missing."""

    log_prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    fixed: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        log_density = [
            self.log_prior[c] - 0.5 * (self.log_det[c] + np.square((x - self.mean[c]) @ self.whiten[c].T).sum(axis=1))
            for c in (0, 1)
        ]
        return 1.0 / (1.0 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, pooling: float, sphering: float) -> Discriminant:
    """From counts, sums and sums of products of both classes, in units of the pooled spread."""
    d = sums.shape[1]
    if not n.all():
        nothing = np.zeros((2, d))
        return Discriminant(np.zeros(2), nothing, np.zeros((2, d, d)), np.zeros(2), 0.5 if not n.any() else float(n[1] > 0))
    mean = sums / n[:, None]
    scatter = products - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    whiten, log_det = [], []
    for c in (0, 1):
        own = (1 - pooling) * scatter[c] / n[c] + pooling * pooled
        own = own / scale[:, None] / scale[None, :]
        own = (1 - sphering) * own + sphering * max(np.trace(own) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor) / scale[None, :])
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(np.log(n / n.sum()), mean, np.array(whiten), np.array(log_det))


def moments(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products by class of ``(x, label)`` rows, added up by Spark."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    terms = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    terms += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *terms).collect():
        c = int(row["label"])
        n[c] = row["n"]
        sums[c] = [row[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            products[c, i, j] = products[c, j, i] = row[f"p{i}_{j}"]
    return n, sums, products


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", pooling: float = POOLING,
        sphering: float = SPHERING) -> Discriminant:
    """The classifier from ``(key, x)`` rows and labels, on all rows that are not held out.

    Labels other than 0 and 1 and null keys are left out. An id that is labelled
    or measured more than once counts as often as its pairs.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    known = known.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    joined = measured.select(F.col(key).alias("key"), "x").join(known, "key")
    return discriminant(*moments(joined), pooling, sphering)


def score_column(model: Discriminant, x: Column) -> Column:
    """The score of a vector column."""

    @F.pandas_udf(T.DoubleType())
    def score(vectors):
        import pandas as pd

        return pd.Series(model.score(np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), len(STATISTICS))))

    return score(x)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of the documents.

    Empty and null texts have the statistics of an empty text and get a score like
    any other. With no usable label every score is 0.5; with one class only, all
    scores are that class. An empty table gives no rows. Columns other than
    ``doc_id`` and ``text`` are not looked at. A null id is never held out.
    """
    measured = written(features(documents.select("doc_id", "text")), "quality-statistics")
    model = fit(measured, labels)
    scored = measured.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        score_column(model, F.col("x")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns.

    Texts are read twice, once to fit and once to decide; they are never shuffled.
    """
    model = fit(written(features(documents.select("doc_id", "text")), "quality-statistics"), labels)
    kept = fresh(documents, "_kept")

    @F.pandas_udf(T.BooleanType())
    def good(texts):
        import pandas as pd

        x = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(STATISTICS))
        return pd.Series(model.score(x) >= threshold)

    return documents.withColumn(kept, good(valid_text("text"))).where(F.col(kept)).drop(kept)
