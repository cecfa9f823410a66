"""State that expires, merged tables, and a baseline that grows while the stream runs."""

import os
import random
import time

import pytest

from keysieve.operators.dedup import keep_earliest
from keysieve.operators.detect import FINDING_COLUMNS, detect
from keysieve.streaming import incremental as I
from keysieve.streaming import keyed as K

SCHEMA = "path string, line_no int, line string, seq bigint, commit_sha string, commit_author string, commit_date string"
LETTERS = "QRSTUVWXYZABCDEFGH234567"


def key(n):
    return "AKIA" + "".join(random.Random(n).sample(LETTERS, 16))


def row(n, seq, line_no, date, mark=""):
    return ("a.go", line_no, f"k {key(n)}{mark}", seq, f"sha{seq}", "me", date)


def same(left, right):
    fields = [c for c in FINDING_COLUMNS if c != "verification"] + ["inline_hits"]
    return sorted(map(repr, left.select(*fields).collect())) == sorted(map(repr, right.select(*fields).collect()))


def feed(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)


@pytest.fixture
def run(spark, rules, tmp_path):
    source = str(tmp_path / "in")

    def step(rows, idle_ms=600_000, every=2, **options):
        feed(spark, source, rows)
        found = I.stream_findings(spark.readStream.schema(SCHEMA).parquet(source), rules, keep=("seq",))
        parts = K.stream_parts(found, idle_ms=idle_ms, **options)
        query = K.write_merged(parts, str(tmp_path / "out"), str(tmp_path / "progress"), every=every, availableNow=True)
        query.awaitTermination()
        batch = keep_earliest(detect(spark.read.schema(SCHEMA).parquet(source), rules, keep=("seq",)), **options)
        assert same(K.merged_rows(spark, str(tmp_path / "out")), batch)
        return query

    return step


def kept(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]


def test_late_earlier_commits_and_hidden_ones(run):
    run([row(1, 5, 42, "2024-05-05"), row(2, 6, 1, None), row(1, 9, 9, "2024-05-05", " // scan:ignore")])
    run([row(1, 7, 7, "2023-01-01"), row(2, 2, 3, "2020-01-01")])
    run([row(1, 8, 9, "2025-01-01"), row(1, 4, 9, "", " // scan:ignore")])
    run([row(3, 1, 1, "2024-01-01")])


def test_strict_rows_without_hidden_ones(run):
    options = {"strict": True, "show_suppressed": False}
    run([row(1, 5, 42, "2024-01-01T00:30:00+05:00"), row(1, 3, 2, "2019-01-01T00:00:00Z", " // scan:ignore")], **options)
    run([row(1, 6, 1, "2023-12-31T20:00:00Z"), row(1, 7, 1, "2023-12-31T19:00:00Z")], **options)


def test_random_batches(run):
    dice = random.Random(1)
    for _ in range(4):
        run([row(dice.randrange(12), dice.randrange(1000), dice.randrange(1, 50), dice.choice([None, "", *(f"202{d}-01-01" for d in range(6))]),
                 dice.choice(["", "", " // scan:ignore"])) for _ in range(60)])


def test_state_expires_and_rows_stay_right(spark, run, tmp_path):
    assert kept(run([row(n, n, 5, "2024-01-01") for n in range(30)], idle_ms=1500)) == 30
    time.sleep(2)
    assert kept(run([row(100, 100, 1, "2024-01-01")], idle_ms=1500)) <= 2
    time.sleep(2)
    # secrets whose state is gone come back, one with an earlier commit and one with a later
    query = run([row(3, 200, 7, "2020-01-01"), row(4, 201, 8, "2030-01-01")], idle_ms=1500)
    assert kept(query) <= 4
    run([row(5, 300, 1, "2019-01-01")], idle_ms=1500)
    rows = {r.fingerprint: r.line for r in K.merged_rows(spark, str(tmp_path / "out")).collect()}
    assert sorted(rows.values()).count(7) == 1 and 8 not in rows.values()


def test_what_is_merged_is_deleted(spark, run, tmp_path):
    for n in range(8):
        run([row(n % 3, n, n + 1, f"20{30 - n}-01-01")])
    changes = K.Folder(spark, f"{tmp_path}/out/changes", K.BATCH).numbers()
    assert len(K.Folder(spark, f"{tmp_path}/out/merged", K.UPTO).numbers()) <= 2 and len(changes) <= 4


def test_an_unfinished_merge_does_not_count(spark, run, tmp_path):
    run([row(1, 1, 1, "2024-01-01")])
    run([row(1, 2, 2, "2023-01-01")])
    (tmp_path / "out" / "merged" / "upto=99").mkdir(parents=True)
    run([row(1, 3, 3, "2022-01-01")])


def test_a_repeated_batch_changes_nothing(spark, run, tmp_path):
    """A failure after a merge, before the batch counts as done: it is run again."""
    run([row(1, 1, 1, "2024-01-01", " // scan:ignore")], every=1)
    run([row(1, 2, 2, "2023-01-01", " // scan:ignore"), row(2, 3, 3, "2023-01-01")], every=1)
    commits = tmp_path / "progress" / "commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if (commits / name).exists():
            os.remove(commits / name)
    run([row(1, 4, 4, "2022-01-01")], every=1)


def test_repositories(spark, rules, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.createDataFrame([row(1, 1, 4, "2024-01-01"), row(1, 2, 5, "2024-01-02")], SCHEMA).selectExpr("*", "concat('r', seq) AS repo")
    frame.write.parquet(source)
    found = I.stream_findings(spark.readStream.schema(frame.schema).parquet(source), rules, keep=("seq", "repo"))
    K.write_merged(K.stream_parts(found, idle_ms=60_000), out, str(tmp_path / "p"), availableNow=True).awaitTermination()
    assert sorted((r.repo, r.line) for r in K.merged_rows(spark, out).collect()) == [("r1", 4), ("r2", 5)]
    assert K.merged_rows(spark, str(tmp_path / "nothing")) is None


def test_a_baseline_that_grows(spark, rules, tmp_path):
    source, base, out = str(tmp_path / "in"), str(tmp_path / "base"), str(tmp_path / "out")
    feed(spark, source, [row(1, 1, 1, "2024-01-01"), row(2, 2, 2, "2024-01-01")])
    found = I.stream_findings(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), rules)
    query = K.write_new(found, base, out, str(tmp_path / "p"), processingTime="0 seconds")
    try:
        query.processAllAvailable()
        assert spark.read.parquet(out).count() == 2
        static = detect(spark.createDataFrame([row(1, 1, 1, "2024-01-01")], SCHEMA), rules)
        assert K.add_known(static, base) == 0
        feed(spark, source, [row(1, 3, 30, "2024-01-01"), row(2, 4, 40, "2024-01-01"), row(3, 5, 50, "2024-01-01")])
        query.processAllAvailable()
        assert sorted(r.line for r in spark.read.parquet(out).collect()) == [1, 2, 40, 50]
        assert K.add_known(detect(spark.createDataFrame([row(2, 1, 1, "2024-01-01"), row(1, 1, 1, "")], SCHEMA), rules), base) == 1
        K.merge_known(spark, base)
        feed(spark, source, [row(1, 6, 60, None), row(2, 7, 70, None), row(3, 8, 80, None)])
        query.processAllAvailable()
        assert sorted(r.line for r in spark.read.parquet(out).collect()) == [1, 2, 40, 50, 80]
    finally:
        query.stop()
    assert K.known_at(spark, base).count() == 2 and K.known_at(spark, base, version=1) is None
