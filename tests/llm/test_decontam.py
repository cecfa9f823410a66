import hashlib
import random
import re

import pytest

from keysieve.llm import decontam
from keysieve.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, length=decontam.WINDOW):
    out = []
    for i, t in rows:
        w, hit, held = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(len(v), length)
            if item is None or not n:
                continue
            for s in range(len(v) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        held.add(str(item))
        sha = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out.append((str(i), len(w), len(hit), len(held), sha, bool(hit)))
    return sorted(set(out))


def found(spark, frame, items):
    items = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.digests(decontam.contamination(frame, items)).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)


def test_against_all_places(spark, docs):
    rng = random.Random(1)
    vocabulary = [f"w{n}" for n in range(12)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for n in range(20, 40)]
    rows = []
    for i in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            source = rng.choice(items)[1].split()
            at = rng.randrange(len(source))
            text[5:5] = source[at : at + 14]
        rows.append((i, ", ".join(text).upper() + "."))
    assert found(spark, docs(rows), items) == brute(rows, items)


def test_odd_rows(spark, docs):
    phrase = "one two three four five six seven eight nine ten eleven"
    items = [(1, phrase), (1, phrase), (2, phrase), (3, None), (4, "..."), (None, "one two"), (5, "É b"), (10, "same same same")]
    rows = [
        (1, f"x {phrase} y"), (1, f"x {phrase} y"), (1, "other text"), (2, None), (3, ""), (4, "-- ..."), (None, phrase.upper()), (5, "é b É B"),
        (6, "same " * 3000), (7, "one two three four five six seven eight nine"), (8, "a_b-c'd"),
    ]
    assert found(spark, docs(rows, extra=True), items) == brute(rows, items)
    assert found(spark, docs([]), items) == []
    assert found(spark, docs(rows), []) == brute(rows, [])
    items = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.keep_clean(docs(rows, extra=True), items)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "7", "8"] and "_dirty_id" in kept.columns


def test_proximity(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "x gamma y beta alpha"), (2, "alpha beta gamma"), (3, "alpha x x x x x x beta gamma"), (4, "alpha beta")]
    frame = docs(rows)
    phrases, _ = decontam.windows(items)
    chosen = decontam.rarest_terms(frame, phrases)
    got = decontam.search(decontam.index(frame, chosen, 5), chosen, slop=2).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == [(1, "proximity"), (2, "phrase")]


def test_proximity_of_whole_windows(spark, docs):
    """Words of a window in another order are found up to the slop, and a reach that would miss them is refused."""
    item = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10"
    items = spark.createDataFrame([(1, item), (2, "q r s")], "item_id long, text string")
    rows = [(1, "b2 c3 d4 e5 f6 g7 h8 i9 j10 x x a1"), (2, f"{item} q x r s"), (3, "b2 c3 d4 e5 f6 g7 h8 i9 j10"), (4, item), (5, None)]
    rows += [(6, "a1 " * 9), (7, "j10 i9 h8 g7 f6 e5 d4 c3 b2 a1 s r q")]
    got = {r.doc_id: (r.n_hit, r.items, r.near_items) for r in decontam.contamination(docs(rows), items, slop=2).collect()}
    assert got == {1: (0, [], ["1"]), 2: (10, ["1"], ["2"]), 3: (0, [], []), 4: (10, ["1"], []), 5: (0, [], []), 6: (0, [], []), 7: (0, [], ["1", "2"])}
    chosen = decontam.rarest_terms(docs(rows), decontam.windows(items)[0])
    postings = decontam.index(docs(rows), chosen, 9)
    assert decontam.search(postings, chosen).where("doc_id = 4").count() == 1
    with pytest.raises(ValueError):
        decontam.search(postings, chosen, slop=2)


def test_repeated_rows(spark, tmp_path):
    """The query has a row for every row of the table, copies of one id and text included."""
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other"), (None, "b c"), (None, "b c"), (2, None), (2, None), (3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in QUERIES["op8_decontamination"](spark, str(tmp_path)).collect())
    assert got == [("1", 1, 0), ("1", 4, 2), ("1", 4, 2), ("2", 0, 0), ("2", 0, 0), ("3", 1, 0), ("None", 2, 2), ("None", 2, 2)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_with_and_without_broadcast(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontam, "broadcast_if_small", lambda f, c: __import__("keysieve.llm.common", fromlist=["x"]).broadcast_if_small(f, c, limit))
    rows = [(1, "a b c d"), (2, "b c")]
    assert found(spark, docs(rows), [(7, "b c")]) == brute(rows, [(7, "b c")])


def test_native_plan(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    plan = decontam.contamination(docs([(1, "x")]), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
