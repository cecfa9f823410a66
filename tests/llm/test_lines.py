import hashlib
import random

import pytest

from keysieve.llm import lines


def key(line):
    line = line.strip(lines.BLANKS)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def brute(rows, least=lines.LEAST_LENGTH):
    owner = {}
    order = lambda i: lines.LAST_ID if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                owner[key(line)] = min(owner.get(key(line), lines.LAST_ID), order(i))
    out = []
    for i, t in rows:
        cut = (t or "").split("\n")
        kept = [line for line in cut if owner.get(key(line), order(i)) == order(i)]
        out.append((str(i), len(cut), len(cut) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def found(frame, **options):
    rows = lines.digests(lines.deduplicated(frame, **options)).collect()
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in rows)


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_against_a_dictionary(docs, batches):
    rng = random.Random(batches)
    pool = [f"  shared LINE number {n}\t" for n in range(40)] + ["short", "", "   ", "exactly 10", "Éxactly 1É", "éxactly 1é"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rng.shuffle(rows)
    assert found(docs(rows).select("doc_id", "text"), batches=batches, fanout=2) == brute(rows)


def test_odd_rows(docs):
    text = "a line of some length\nanother such line"
    rows = [
        (5, text), (5, text), (5, "a line of some length\nown"), (2, None), (3, ""), (4, "\n\n"), (None, text), (7, text.upper()),
        (8, "a line of some length\n" * 4000), (9, "x\r\nA LINE of some length\r\n"), (10, "trailing newline kept\n"),
    ]
    assert found(docs(rows)) == brute(rows)
    assert lines.deduplicated(docs([])).collect() == []
    kept = lines.deduplicated(docs(rows, extra=True), counts=("_a", "_b"))
    assert {r.n_lines for r in kept.collect()} == {"x"} and "version" in kept.columns


def test_runs_are_sorted_disjoint_and_levelled(spark, tmp_path):
    from pyspark.sql import functions as F

    runs = lines.Runs(fanout=2)
    for start in range(0, 5):
        keys = spark.range(start * 10, start * 10 + 15).select(
            F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"), F.lit(start).cast("long").alias("owner")
        )
        runs.add(runs.unknown(keys))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r.h1: r.owner for r in runs.all_keys().collect()} == {n: 0 if n < 15 else (n - 5) // 10 for n in range(55)}
    assert runs.all_keys().count() == 55


def test_native_plan(docs):
    plan = lines.deduplicated(docs([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
