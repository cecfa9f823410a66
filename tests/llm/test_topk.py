import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.llm import topk
from keysieve.llm.oracles import ORACLES
from keysieve.llm.queries import QUERIES


def brute(rows, k):
    """Rows ``(id, vector)``, one per id; queries are ids divisible by 50."""
    usable = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in usable:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(spark, rows, k, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS id", "'y' AS v")
    vectors = topk.one_per_id(frame, "vec_id", "embedding")
    return sorted(tuple(r) for r in topk.search(vectors, vectors.where(F.col("id") % 50 == 0), k, **options).collect())


@pytest.mark.parametrize("block_rows", [20, 100_000])
def test_against_all_products(spark, monkeypatch, block_rows):
    monkeypatch.setattr(topk, "FIRST_DEPTH", 3)
    monkeypatch.setattr(topk, "LEAST_BLOCKS", 3)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 4)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(0, 700)]
    rows += [(i, rows[5][1]) for i in range(1000, 1100)]  # copies tie
    assert found(spark, rows, 5, block_rows=block_rows) == brute(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [1.0, inf]), (250, [1.0, None]), (None, [1.0, 1.0]),
            (3, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [-1.0, 0.001]), (300, []), (6, [2.0])]
    assert found(spark, rows, 5) == brute([(i, [*v, *[0.0] * (2 - len(v))] if v is not None else None) for i, v in rows], 5)
    assert found(spark, [*rows, (0, [1.0, -2.0]), (3, [5.0, 5.0])], 5) == found(spark, rows, 5)
    assert found(spark, [(0, [1.0])], 5) == [] and found(spark, [(1, [1.0])], 5) == []
    empty = topk.one_per_id(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert topk.search(empty, empty, 5).collect() == []


def test_repeated_ids(spark, tmp_path):
    """Every row is a candidate, also under an id that repeats, as in the SQL twin."""
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=4))]) for i in [*range(0, 120), *range(0, 120, 3), 50, 50, 7, 7]]
    rows += [(9, [30.0, 30.0, 30.0, 30.0]), (9, [30.0, 30.0, 30.0, 30.0]), (9, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLES["op10_topk"]).fetchall()
    got = QUERIES["op10_topk"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_reading_stops_early():
    rng = np.random.default_rng(0)
    rows = rng.integers(-5, 5, size=(5000, 4)).astype(np.float64)
    rows[7] = [900, -900, 900, 900]
    lists = topk.SortedLists(np.arange(5000), rows)
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            reads.append(at)
            return super().__getitem__(at)

    lists.order = lists.order.view(Counted)
    places, scores = lists.best(-1, np.array([1.0, -1.0, 1.0, 1.0]), 1)
    assert places.tolist() == [7] and scores.tolist() == [3600] and len(reads) == 2
