"""The data source for exports: batches equal the reader of files, streams give each commit once."""

import io
import random

import pytest

from keysieve.sources.patches import added_lines, read_history, split_commits
from keysieve.streaming import exports as E
from keysieve.streaming import incremental as I

LETTERS = "QRSTUVWXYZABCDEFGH234567"


def commit(n, lines=1):
    key = "AKIA" + "".join(random.Random(n).sample(LETTERS, 16))
    body = "".join(f"+k {key} {i}\n" for i in range(lines))
    return (f"commit {n:040x}\nAuthor: A <a@b.c>\nDate:   2024-01-01T00:00:{n % 60:02}Z\n\n    m\n    commit not one\n\n"
            f"diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -0,0 +1,{lines} @@\n{body}")  # fmt: skip


def test_records_of_ranges():
    dice = random.Random(1)
    for _ in range(200):
        head = dice.choice([b"", b"noise\n"])
        parts = [b"commit " + b"x" * dice.randrange(0, 9) + b"\n" + dice.choice([b"", b" commit y\n", b"\n"]) for _ in range(dice.randrange(0, 6))]
        data = head + b"".join(parts)
        handle, want = io.BytesIO(data), [p.removesuffix(b"\n") for p in parts]
        step = dice.randrange(1, 40)
        got = [r for a in range(0, len(data), step) for r in E.records(handle, a, min(a + step, len(data)), len(data), b"commit ")]
        assert [text for _, text in got] == want
        last = E.last_record(handle, len(data), 0, b"commit ")
        assert (last or 0) == (len(data) - len(parts[-1]) if parts else 0)
        if len(got) > 1:
            assert E.last_record(handle, len(data), got[-1][0], b"commit ") == got[-1][0]


def test_steps_do_not_show(monkeypatch):
    monkeypatch.setattr(E, "STEP", 3)
    data = b"commit a\nxx\ncommit b\n" + b"y" * 50 + b"\ncommit c\n"
    assert [a for a, _ in E.records(io.BytesIO(data), 0, len(data), len(data), b"commit ")] == [0, 12, 72]
    assert E.last_record(io.BytesIO(data), len(data), 5, b"commit ") == 72
    assert E.last_record(io.BytesIO(data), 60, 12, b"commit ") == 12


@pytest.mark.parametrize("size", [None, 200])
def test_a_batch_equals_the_reader_of_files(spark, tmp_path, size):
    E.register(spark)
    for repo in ("one", "two"):
        text = "".join(commit(n, 1 + n % 4) for n in range(30)).encode()
        (tmp_path / f"{repo}.log").write_bytes(text + b"+\xff raw AKIA\n")
    reader = spark.read.format(E.NAME)
    frame = (reader.option("range_bytes", size) if size else reader).load(str(tmp_path))
    assert frame.count() == 60 and frame.rdd.getNumPartitions() >= (20 if size else 2)
    names = ["repo", "path", "line_no", "line", "commit_sha", "commit_author", "commit_date"]
    rows = [sorted(map(repr, added_lines(f).select(*names).collect())) for f in (split_commits(frame), read_history(spark, str(tmp_path)))]
    assert rows[0] == rows[1] and len(rows[0]) > 100
    (tmp_path / "none").mkdir()
    assert spark.read.format(E.NAME).load(str(tmp_path / "none")).count() == 0


def test_each_commit_once_over_a_restart(spark, rules, tmp_path):
    E.register(spark)
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    folder.mkdir()

    def append(name, text):
        with open(folder / name, "a") as file:
            file.write(text)

    def start():
        commits = spark.readStream.format(E.NAME).option("range_bytes", 300).load(str(folder))
        found = I.stream_findings(added_lines(split_commits(commits)), rules, keep=("repo",))
        return I.write_appended(found, out, progress, processingTime="0 seconds")

    def seen():
        rows = spark.read.parquet(out).collect()
        return sorted((r.repo, int(r.commit_sha, 16)) for r in rows)

    append("a.log", commit(1) + commit(2))
    query = start()
    try:
        query.processAllAvailable()
        assert seen() == [("a", 1)]  # the last commit may still grow
        append("a.log", commit(3)[:60])
        query.processAllAvailable()
        assert seen() == [("a", 1), ("a", 2)]
    finally:
        query.stop()
    append("a.log", commit(3)[60:] + "".join(commit(n) for n in range(4, 9)))
    append("b.log", commit(11) + commit(12))
    query = start()
    try:
        query.processAllAvailable()
        assert seen() == [("a", n) for n in range(1, 8)] + [("b", 11)]
        append("b.log", commit(13))
        query.processAllAvailable()
        assert seen() == [("a", n) for n in range(1, 8)] + [("b", 11), ("b", 12)]
    finally:
        query.stop()


def test_shorter_files_are_refused(tmp_path):
    (tmp_path / "a.log").write_text(commit(1))
    exports = E.Exports({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="shorter"):
        exports.complete("a.log", 10, 20, False)
    assert exports.complete("a.log", len(commit(1)), 0, False) == 0 and exports.complete("a.log", 7, 0, True) == 7
