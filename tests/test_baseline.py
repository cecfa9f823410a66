"""Stored baselines: every layout read by many tasks, repositories kept apart, and applied to a scan."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keysieve.operators.detect import FINDING_COLUMNS, detect
from keysieve.operators.suppress import known_findings, new_findings
from keysieve.plans.scan import scan_texts
from keysieve.sources import baseline as B
from keysieve.sources.baseline import STORED_SCHEMA, read_baseline, write_baseline
from keysieve.sources.json_records import array_records

TOKEN = "id AKIA{}"


@pytest.fixture
def found(spark, rules):
    letters = "QRSTUVWXYZABCDEFGH234567"
    lines = [(f"r{n % 2}", f"d/f{n}.go", n + 1, TOKEN.format("".join(random.Random(n // 2).sample(letters, 16)))) for n in range(40)]
    frame = spark.createDataFrame(lines, "repo string, path string, line_no int, line string")
    return detect(frame, rules, keep=("repo",))


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def findings(n, seed):
    dice = random.Random(seed)
    odd = ['plain', 'quote " brace } and { here', 'back\\slash \\" end\\', "[]}{", "}", '"', "\\", "tab\tnew\nline", "é中🙂 ", ""]
    rows = []
    for i in range(n):
        row = {"rule_id": "r", "file": dice.choice(odd), "line": i, "column": 1, "match": dice.choice(odd), "fingerprint": f"f:{dice.choice(odd)}:{i}"}
        if dice.random() < 0.4:
            row["verification"] = {"status": dice.choice(odd), "provider": "p"}
        if dice.random() < 0.3:
            row["suppressed"] = True
        rows.append(row)
    return rows


def dumped(rows, layout):
    whole = {"version": 1, "findings": rows}
    if layout == "odd":
        text = json.dumps({"tool": "x", "version": 1, "findings": rows, "note": "n", "ok": True}, ensure_ascii=False, separators=(" ,\r\n", "\t:  "))
        return "\n " + text + " \n\n"
    return json.dumps(whole, **{"indented": {"indent": 2}, "broken": {"indent": "\t", "ensure_ascii": False}, "unbroken": {}}[layout])


@pytest.mark.parametrize("layout", ["indented", "broken", "unbroken", "odd"])
@pytest.mark.parametrize("n", [1, 3, 60])
def test_every_layout(spark, tmp_path, small_blocks, layout, n):
    rows = findings(n, n)
    path = tmp_path / "base.json"
    path.write_text(dumped(rows, layout), encoding="utf-8")
    records = array_records(spark, str(path))
    assert records.filter("not last").count() == n
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > (4 if n == 60 else 0)
    read = [json.loads(r[0]) for r in read_baseline(spark, str(path)).select(F.to_json(F.struct("*"))).collect()]
    assert sorted(read, key=lambda r: r["line"]) == rows
    assert B._any_layout(spark, str(path)) is not None


def test_several_documents(spark, tmp_path, small_blocks):
    for i in range(3):
        (tmp_path / f"b{i}.json").write_text(dumped(findings(5, i), "indented") + "\n" * i, encoding="utf-8")
    assert read_baseline(spark, str(tmp_path), format="envelope").count() == 15


@pytest.mark.parametrize("text", [
    '{"version": 1, "findings": [', '{"version": 1, "findings": [{"line": 1}', '{"version": 1, "findings": [{"line": 1} {"line": 2}]}',
    '{"version": 1, "findings": [{"line": 1}]', '{"version": 1, "findings": [{"line": "x"}]}', '{"version": 1, "findings": [{"line": 1}],}',
    '{"version": 1, "findings": [{"line": 1}, {"line": 2,}]}', "no json {}",
])
def test_malformed_documents_fail(spark, tmp_path, text):
    path = tmp_path / "base.json"
    path.write_text(text)
    with pytest.raises(Exception):
        read_baseline(spark, str(path)).collect()


@pytest.mark.parametrize("text", ['{"version": 1, "findings": null}', '{"findings": []}', '{"version":1,"findings":[ ]}\n'])
def test_documents_without_findings(spark, tmp_path, found, text):
    path = tmp_path / "base.json"
    path.write_text(text)
    base = read_baseline(spark, str(path))
    assert base.count() == 0 and new_findings(found, base).count() == 40


def test_findings_before_other_members_are_read_whole(spark, tmp_path):
    path = tmp_path / "base.json"
    path.write_text(json.dumps({"meta": {"a": [1]}, "findings": findings(3, 1)}))
    assert B._any_layout(spark, str(path)) is None and read_baseline(spark, str(path)).count() == 3


@pytest.mark.parametrize("kind", ["envelope", "parquet", "json"])
def test_a_stored_baseline_is_applied(spark, rules, tmp_path, found, kind):
    """What was written is known afterwards, in its own repository only."""
    path = str(tmp_path / "base")
    write_baseline(found.filter("repo = 'r0'"), path, format=kind)
    base = read_baseline(spark, path, format=kind)
    assert set(base.columns) == {*FINDING_COLUMNS, "repo"}
    assert {r.repo for r in known_findings(found, base).collect()} == {"r0"}
    assert {r.repo for r in new_findings(found, base).collect()} == {"r1"}
    assert known_findings(found, base, any_repo=True).count() == 40
    write_baseline(found.drop("repo").filter("line <= 20"), path + "2", format=kind)
    plain = read_baseline(spark, path + "2", format=kind)
    assert plain.columns == FINDING_COLUMNS_LIST
    assert new_findings(found.drop("repo"), plain).count() == 20
    with pytest.raises(ValueError, match="repo"):
        new_findings(found, plain)


FINDING_COLUMNS_LIST = list(FINDING_COLUMNS)


def test_a_scan_with_a_written_envelope(spark, rules, tmp_path):
    texts = spark.createDataFrame([("a", TOKEN.format("QRSTUVWXYZ234567")), ("b", TOKEN.format("ZYXWVUTSRQ765432"))], "path string, text string")
    first = scan_texts(texts.filter("path = 'a'"), rules)
    write_baseline(first.new_findings(), str(tmp_path / "b.json"), format="envelope")
    again = scan_texts(texts, rules, baseline=read_baseline(spark, str(tmp_path / "b.json")))
    assert [r.file for r in again.displayed.collect()] == ["b"]
    assert again.summary.first().suppressed == {"baseline": 1}


def test_a_missing_baseline_is_empty(spark, tmp_path, found):
    base = read_baseline(spark, str(tmp_path / "none.json"))
    assert new_findings(found, base).count() == 40
    assert spark.createDataFrame([], STORED_SCHEMA).columns == base.columns
