import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.llm import neardup
from keysieve.llm.graph import components


def brute(rows, near):
    """Components of ``(doc_id, text)`` rows by comparing all pairs."""
    sets = [(i, neardup.shingles(t, near.words)) for i, t in rows]
    parent = {n: n for n in range(len(sets))}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(range(len(sets)), 2):
        if sets[a][0] is not None and sets[b][0] is not None and neardup.similar(sets[a][1], sets[b][1], near.percent):
            parent[top(a)] = top(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[top(n)] = min(least.get(top(n), i), i)
    return sorted((str(i), len(s), least.get(top(n)) if i is not None else None) for n, (i, s) in enumerate(sets))


def found(frame, near):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in neardup.components_of(frame, near).collect())


def corpus(seed, groups=6, copies=25, words=60):
    """Random texts, and groups whose members are edited copies near the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(400)]
    rows, number = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 9)):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((number, " ".join(text)))
            number += 1
    rows += [(number + n, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for n in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_against_all_pairs(docs, words, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 4)
    near = neardup.Near(words=words)
    rows = corpus(words)
    assert found(docs(rows).repartition(4), near) == brute(rows, near)


def test_odd_rows(docs):
    rows = [
        (9, "A b c d e f"), (3, "a B\tc  d e\nf"), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "ONE"), (10, "one two"),
        (11, "a b a b"), (12, "a b a b a b"), (13, "word " * 5000), (14, "word " * 6000), (None, "a b c d e f"), (3, "a B\tc  d e\nf"),
        (15, "É b"), (16, "é b"),
    ]
    for words in (2, 5):
        near = neardup.Near(words=words)
        assert found(docs(rows, extra=True), near) == brute(rows, near)
    assert neardup.components_of(docs([])).collect() == []
    kept = neardup.keep_one(docs(rows, extra=True), neardup.Near(words=2))
    assert "bucket" in kept.columns and "_removed_id" in kept.columns
    left = {r.doc_id for r in kept.collect()}
    assert 9 not in left and {3, 4, 5, 6, 7, 10, 11, 13, 15, 16, None} <= left and not {8, 12, 14} & left


def test_sketch_is_filled_and_concentrated():
    seed = neardup.seeds(400, 1)
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 160, 3000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (neardup.sketch(x, 200, seed) != neardup.UNFILLED).all()
    errors = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = neardup.sketch(x[:270], 200, seed), neardup.sketch(x[30:], 200, seed)
        errors.append((a == b).mean() - 240 / 300)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < np.sqrt(0.8 * 0.2 / 200) * 1.2


def test_cells_meet_every_pair_across_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 3)
    rows = [(100, i, 100 if i < 10 else 200 + i % 4) for i in range(17)] + [(50, 50, 50), (50, 51, 51)]
    members = spark.createDataFrame(rows, "home long, id long, label long")
    met = set()
    groups = {}
    for r in neardup.cells(members).collect():
        groups.setdefault((r.home, r.kind, r.i, r.j), []).append((r.id, r.label, r.side))
    for cell in groups.values():
        assert len(cell) <= 17
        for a, b in combinations(sorted(cell), 2):
            if (a[2] == b[2] == 2 or {a[2], b[2]} == {0, 1}) and a[1] != b[1]:
                met.add((a[0], b[0]))
    want = {(a[1], b[1]) for a, b in combinations(sorted(rows), 2) if a[0] == b[0] and a[2] != b[2]}
    assert met == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.union(spark.range(1).select(F.lit(500).cast("long"), F.lit(400).cast("long")))
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{n: 1 for n in range(1, 201)}, 400: 400, 500: 400}
    assert components(edges.where("a < 0")).collect() == []
