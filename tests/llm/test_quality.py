import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.llm import quality
from keysieve.llm.common import fold_of


def test_moments_and_scores_against_numpy(spark, docs):
    rng = np.random.default_rng(0)
    good = [(i, " ".join("lorem ipsum dolor sit amet".split() * rng.integers(1, 9)) + ".") for i in range(150)]
    junk = [(i, "".join(rng.choice(list("#$%& A1"), rng.integers(5, 200)))) for i in range(150, 300)]
    labels = [(i, 1) for i in range(150)] + [(i, 0) for i in range(150, 300)] + [(None, 1), (1, None), (7, 5), (9999, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = good + junk
    found = {r.doc_id: r for r in quality.classify(docs(rows, extra=True), labels).collect()}
    x = np.array([quality.statistics(t) for _, t in rows])
    y = np.array([1] * 150 + [0] * 150)
    learn = np.array([fold_of(i) != 0 for i, _ in rows])
    n = np.array([(learn & (y == c)).sum() for c in (0, 1)], dtype=float)
    sums = np.array([x[learn & (y == c)].sum(axis=0) for c in (0, 1)])
    products = np.array([x[learn & (y == c)].T @ x[learn & (y == c)] for c in (0, 1)])
    scores = quality.discriminant(n, sums, products, quality.POOLING, quality.SPHERING).score(x)
    assert np.allclose([found[i].score for i, _ in rows], scores, atol=1e-6)
    for (i, _), score in zip(rows, scores):
        assert found[i].held_out == (fold_of(i) == 0) and found[i].predicted == int(found[i].score >= 0.3)
    assert ((scores >= 0.3) == (y == 1))[~learn].mean() > 0.95
    kept = {r.doc_id for r in quality.keep_good(docs(rows, extra=True), labels).collect()}
    assert kept == {i for i, _ in rows if found[i].predicted}


def test_density_difference_is_the_normal_one():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    samples = [rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) + c for c in (0, 1)]
    n = np.array([400.0, 400.0])
    model = quality.discriminant(n, np.array([s.sum(0) for s in samples]), np.array([s.T @ s for s in samples]), 0.0, 0.0)
    x = samples[0][:5]
    want = []
    for s in samples:
        mean, cov = s.mean(0), np.cov(s.T, bias=True)
        diff = x - mean
        want.append(-0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ni,ij,nj->n", diff, np.linalg.inv(cov), diff)))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.clip(want[0] - want[1], -700, 700))), atol=1e-9)


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 1), (2, 1), (3, 1)], 1.0), ([(1, 0), (2, 0), (3, 0)], 0.0)])
def test_missing_classes(spark, docs, labels, score):
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = [(1, "text"), (2, None), (2, None), (3, ""), (None, "x " * 50000)]
    found = quality.classify(docs(rows), labels).collect()
    assert len(found) == 5 and {r.score for r in found} == {score} and {r.predicted for r in found} == {int(score >= 0.3)}
    assert quality.classify(docs([]), labels).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.classify(documents, labels).where("held_out").join(labels, "doc_id")
    row = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("accuracy")).first()
    assert row.accuracy > 0.98
