"""Expiring state that many fingerprints share, and merges whose work is in proportion to the changes."""

import random

import pytest

from keysieve.operators.dedup import keep_earliest
from keysieve.operators.detect import FINDING_COLUMNS, detect
from keysieve.streaming import incremental as I
from keysieve.streaming import keyed as K

SCHEMA = "path string, line_no int, line string, seq bigint, commit_sha string, commit_author string, commit_date string"
LETTERS = "QRSTUVWXYZABCDEFGH234567"


def row(n, seq, line_no, date, mark=""):
    key = "AKIA" + "".join(random.Random(n).sample(LETTERS, 16))
    return ("a.go", line_no, f"k {key}{mark}", seq, f"sha{seq}", "me", date)


def same(left, right):
    fields = [c for c in FINDING_COLUMNS if c != "verification"] + ["inline_hits"]
    return sorted(map(repr, left.select(*fields).collect())) == sorted(map(repr, right.select(*fields).collect()))


@pytest.fixture
def run(spark, rules, tmp_path):
    source = str(tmp_path / "in")

    def step(rows, every, **options):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        found = I.stream_findings(spark.readStream.schema(SCHEMA).parquet(source), rules, keep=("seq",))
        parts = K.stream_parts(found, idle_ms=600_000, **options)
        query = K.write_merged(parts, str(tmp_path / "out"), str(tmp_path / "progress"), every=every, availableNow=True)
        query.awaitTermination()
        batch = keep_earliest(detect(spark.read.schema(SCHEMA).parquet(source), rules, keep=("seq",)))
        assert same(K.merged_rows(spark, str(tmp_path / "out")), batch)
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]

    return step


def test_fingerprints_share_buckets(run):
    """The state has a row per bucket, and each fingerprint of a bucket keeps its own place in it."""
    assert run([row(n, n, 5, "2024-01-01") for n in range(60)], every=2, buckets=4) == 4
    later = [row(n, 100 + n, 6, f"20{n % 30 + 10}-01-01", " // scan:ignore") for n in range(0, 90, 2)]
    assert run(later, every=2, buckets=4) == 4


def test_small_changes_wait_for_more_of_them(spark, run, tmp_path):
    """A large merged table is not written again for every few small batches."""
    merges = K.Folder(spark, f"{tmp_path}/out/merged", K.UPTO)
    run([row(n, n, 5, "2024-01-01") for n in range(2000)], every=1)
    run([row(1, 3000, 3, "2023-01-01")], every=1)
    run([row(2, 3001, 3, "2023-01-01")], every=1)
    assert merges.numbers() == [0]
    run([row(9000 + n, n, 5, "2024-01-01") for n in range(2500)], every=1)
    assert merges.numbers() == [0, 3]
