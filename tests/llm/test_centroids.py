"""Clustering against brute force: every distance taken, exact integers of Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keysieve.llm import centroids

FRAME = "vec_id long, embedding array<float>"


def near(vector, points):
    return min((sum((a - b) ** 2 for a, b in zip(vector, c)), n) for n, c in enumerate(points))


def brute(rows, k, rounds, dimensions, salt="2:"):
    """Rows of the whole query for ``(vec_id, vector)`` pairs."""
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
              if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest(), v) for i, v in usable)
    points = [v for _, v in hashed[:k]]
    for _ in range(rounds):
        members = [[] for _ in points]
        for _, v in usable:
            members[near(v, points)[1]].append(v)
        points = [[sum(c) // len(m) for c in zip(*m)] if m else p for m, p in zip(members, points)]
    last = [(i, *near(v, points)) for i, v in usable]
    inertia = {n: sum(d for _, d, m in last if m == n) for _, _, n in last}
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(map(repr, [(i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in last]))


def found(frame, k, rounds, dimensions):
    vectors = centroids.integer_vectors(frame, "vec_id", "embedding", dimensions)
    rows = centroids.digests(centroids.cluster(vectors, k, rounds, dimensions)).collect()
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in rows)


SMALL = st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(SMALL, SMALL)
def test_the_tree_finds_the_nearest_with_ties(points, rows):
    tree = centroids.VantageTree(np.array(points, dtype=np.int64))
    number, distance, _ = tree.nearest(np.array(rows, dtype=np.int64))
    assert [(d, n) for d, n in zip(distance.tolist(), number.tolist())] == [near(r, points) for r in rows]


@pytest.mark.parametrize("magnitude", [100, 10**6, centroids.largest(64)])
def test_exact_in_every_number_type(magnitude):
    dice = random.Random(magnitude)
    points = [[dice.choice((-1, 1)) * (magnitude - dice.randrange(3)) for _ in range(64)] for _ in range(30)]
    rows = [[x + dice.randrange(2) if abs(x) < magnitude else x for x in dice.choice(points)] for _ in range(50)]
    tree = centroids.VantageTree(np.array(points, dtype=np.int64))
    number, distance, _ = tree.nearest(np.array(rows, dtype=np.int64))
    assert [(d, n) for d, n in zip(distance.tolist(), number.tolist())] == [near(r, points) for r in rows]


def test_the_bound_spares_distances():
    dice = np.random.default_rng(1)
    points = np.repeat(dice.integers(-1000, 1000, (10, 64)), 4, axis=0) + dice.integers(-5, 6, (40, 64))
    rows = points[dice.integers(0, 40, 500)] + dice.integers(-9, 10, (500, 64))
    _, _, taken = centroids.VantageTree(points).nearest(rows)
    assert taken < 0.4 * points.shape[0] * rows.shape[0]


ODD = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (1, [0.25, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [None, 1.0]),
       (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [-0.001, 7.0]), (None, [3.0, -2.5]), (9, [0.0, 0.0])]


@pytest.mark.parametrize("k,rounds", [(1, 3), (3, 0), (3, 4), (40, 5)])
def test_odd_rows(spark, k, rounds):
    frame = spark.createDataFrame(ODD * 2, FRAME).selectExpr("*", "'x' AS id", "'y' AS v", "'z' AS cluster", "1 AS distance", "2 AS n")
    assert found(frame, k, rounds, 2) == brute(ODD * 2, k, rounds, 2)


def test_random_rows_in_many_partitions(spark):
    dice = random.Random(7)
    rows = [(i, [dice.randrange(-4, 5) / 8 for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [0.125] * 4) for i in range(300)]  # a third are copies
    assert found(spark.createDataFrame(rows, FRAME).repartition(7), 12, 5, 4) == brute(rows, 12, 5, 4)


def test_empty_clusters_stay(spark):
    rows = [(i, [1.0, 1.0]) for i in range(5)] + [(9, [4.0, 4.0])]
    assert found(spark.createDataFrame(rows, FRAME), 6, 3, 2) == brute(rows, 6, 3, 2)


def test_nothing_to_cluster(spark):
    frame = spark.createDataFrame([(2, None), (3, [1.0])], FRAME)
    assert found(frame, 3, 2, 2) == []


def test_refusals(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], FRAME)
    with pytest.raises(Exception, match="would not fit"):
        centroids.integer_vectors(frame, "vec_id", "embedding", 2).collect()
    with pytest.raises(ValueError):
        centroids.cluster(centroids.integer_vectors(frame, "vec_id", "embedding", 2), k=0)
