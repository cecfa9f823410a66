"""The plans that matter at scale, checked by their operators."""

import contextlib
import io

from pyspark.sql import functions as F

from keysieve.catalog import corpus
from keysieve.functions.globs import path_matcher
from keysieve.functions.joins import hot_keys, key_hash, salted_lookup
from keysieve.operators import detect as D
from keysieve.operators import suppress as S
from keysieve.operators.dedup import keep_earliest
from keysieve.operators.files import select_files
from keysieve.operators.verify import label
from keysieve.plans.report import SORT_COLUMNS, numbered, report_json, summary
from keysieve.sources.exports import read_export
from keysieve.sources.patches import added_lines, split_commits
from keysieve.sources.scratch import materialized
from keysieve.sources.rulesets import Rule, RuleSet

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct")


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    text = out.getvalue()
    assert not any(name in text for name in FORBIDDEN)
    return text


def lines(spark):
    return spark.read.schema("path string, line_no int, line string, extra string").parquet(_lines_path(spark))


def _lines_path(spark):
    path = getattr(spark, "_plan_lines", None)
    if path is None:
        from keysieve.sources.scratch import scratch_path

        path = spark._plan_lines = scratch_path(spark, "plan-lines")
        spark.createDataFrame([("p", 1, "x", "e")], "path string, line_no int, line string, extra string").write.parquet(path)
    return path


def test_detection_is_narrow_and_native(spark, rules):
    text = plan(D.detect(lines(spark), rules))
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<path:string,line_no:int,line:string>" in text
    assert "IsNotNull(line)" in text.split("PushedFilters:")[1].split("\n")[0]


def test_only_uncuttable_rules_bring_python(spark):
    nested = RuleSet(rules=(Rule("n", "(?:a(b)|c)+", ("a",)),))
    text = plan(D.detect(lines(spark), nested))
    assert "ArrowEvalPython" in text and "Exchange" not in text


def test_whole_texts_are_gated_before_they_are_cut(spark, rules, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("path"), "text")
    text = plan(D.detect_texts(texts, rules))
    assert text.index("Filter") < text.index("Generate") if "Generate" in text else False
    assert "ReadSchema: struct<text:string,source:string>" in text and "Exchange" not in text


def test_added_lines_need_no_window(spark, sf_dir):
    rows = spark.createDataFrame(
        [], "seq bigint, commit_sha string, author string, commit_date string, old_path string, new_path string, patch string"
    )
    text = plan(added_lines(rows))
    assert "Exchange" not in text and "Window" not in text


def test_dedup_reduces_before_it_shuffles(spark, rules):
    found = D.detect(lines(spark).withColumn("seq", F.col("line_no")), rules, keep=("seq",))
    text = plan(keep_earliest(found))
    assert text.count("Exchange (") <= 2 and "partial_min_by" in text and "Window" not in text


def test_baseline_is_one_salted_equi_join(spark, rules):
    found = D.detect(lines(spark), rules)
    base = spark.read.schema("fingerprint string").parquet(_lines_path(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(S.mark_known(found, base))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "_salt" in text and " OR " not in text.split("SortMergeJoin")[1][:400]


def test_labels_use_salted_joins(spark, rules):
    found = D.detect(lines(spark), rules, keep_raw=True)
    status = spark.read.schema("provider string, secret_sha256 string, status string").parquet(_lines_path(spark))
    assert "_salt" in plan(label(found, status, show_suppressed=True))


def test_disjoint_roots_need_no_shuffle(spark):
    rows = spark.read.schema("root_ord int, abs_path string, path string, size bigint").parquet(_lines_path(spark))
    assert "Exchange" not in plan(select_files(rows, path_matcher(), overlapping=False))
    assert "Window" in plan(select_files(rows, path_matcher()))


def test_contents_are_not_shuffled_for_a_few_repeated_files(spark):
    schema = "root_ord int, abs_path string, path string, size bigint, content binary, error string"
    rows = spark.createDataFrame([(0, "/a", "a", 1, b"x", None), (1, "/a", "b", 1, b"x", None), (1, "/c", "c", 1, b"x", None)], schema)
    chosen = select_files(rows, path_matcher())
    assert sorted((r.path, r.status) for r in chosen.collect()) == [("a", "selected"), ("b", "duplicate"), ("c", "selected")]
    assert "Window" not in plan(chosen)


def test_a_hot_key_is_spread(spark):
    hot = spark.range(4000).selectExpr("'k' AS key", "id AS n")
    lookup = spark.createDataFrame([("k", 1), ("z", 2)], "key string, v int")
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    for name, value in zip(settings, ("-1", "false")):
        spark.conf.set(name, value)
    try:
        joined = salted_lookup(hot, lookup, ["key"], ["n"])
        sizes = joined.groupBy(F.spark_partition_id()).agg(F.count("v")).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sum(s[1] for s in sizes) == 4000 and max(s[1] for s in sizes) < 4000


def test_a_repeated_lookup_is_not_sent_to_the_driver(spark):
    """Its file is far below the broadcast limit, what is made of it is not."""
    lookup = materialized(spark.range(130_000).selectExpr("concat('k', id) AS key", "'active' AS status"), "lookup")
    frame = materialized(spark.range(1000).selectExpr("concat('k', id) AS key", "id AS n"), "frame")
    joined = salted_lookup(frame, lookup, ["key"], ["n"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert joined.filter("status = 'active'").count() == 1000
    assert "BroadcastHashJoin" in salted_lookup(frame, lookup, ["key"], ["n"], hot=[])._jdf.queryExecution().sparkPlan().toString()


def test_only_hot_keys_are_spread(spark):
    """Measured keys: the same rows as a plain join, the lookup repeated for hot keys alone."""
    frame = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', if(id % 50 = 1, 'warm', concat('k', id % 700))) AS key", "id AS n")
    frame = frame.unionByName(spark.sql("SELECT CAST(NULL AS string) AS key, 5L AS n"))
    lookup = spark.range(700).selectExpr("concat('k', id) AS key", "id AS v").unionByName(spark.sql("SELECT 'hot' AS key, -1L AS v"))
    hot = hot_keys(frame, ["key"])
    named = {r["h"]: r["key"] for r in frame.select("key", key_hash(["key"]).alias("h")).distinct().collect()}
    assert sorted(named[h] for h in hot) == ["hot", "warm"]
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    for name, value in zip(settings, ("-1", "false")):
        spark.conf.set(name, value)
    try:
        joined = salted_lookup(frame, lookup, ["key"], ["n"], hot=hot)
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, frame.join(lookup, "key", "left").select("key", "n", "v").collect()))
        sizes = joined.filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        text = plan(joined)
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert len(sizes) > 1 and text.count("Exchange (") <= 3
    assert hot_keys(frame.limit(0), ["key"]) == [] and hot_keys(frame.filter("key LIKE 'k%'"), ["key"]) == []
    assert salted_lookup(frame, lookup, ["key"], ["n"], hot=[]).count() == 20_001


def test_a_scan_detects_once(spark, sf_dir):
    from keysieve.catalog import queries

    for name in ("report_lines", "report_json", "scan_summary", "history_report"):
        text = plan(queries.QUERIES[name](spark, sf_dir))
        assert "rule_ord" not in text and "content:binary" not in text, name


def test_report_never_gathers_findings(spark, rules):
    found = D.detect(lines(spark), rules)
    covered = spark.createDataFrame([(1,)], "files_scanned bigint")
    text = plan(report_json(found, summary(found, covered)))
    assert "Window" not in text and "Sort [" not in text


def test_corpus_files_are_small(spark, sf_dir):
    assert corpus.leaks(spark, sf_dir).groupBy("path").count().agg(F.max("count")).first()[0] <= 10


def test_numbering_runs_its_input_once(spark):
    """A sort reads its input twice; what is sorted is written first."""
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    columns = ", ".join(f"{c} string" for c in SORT_COLUMNS)
    rows = spark.range(1000).selectExpr(*(f"cast(id * 7919 % 1000 AS string) AS {c}" for c in SORT_COLUMNS))
    numbers = numbered(rows.repartition(4).mapInArrow(counting, columns))
    assert numbers.agg(F.max("row_no")).first()[0] == 1000 and seen.value == 1000


def test_paths_are_looked_for_once_per_file(spark):
    """A column that the next step uses several times is a step of its own, not repeated in each use."""
    commits = spark.createDataFrame([(1, "commit x\ndiff --git a/p b/p\n--- a/p\n+++ b/p\n@@ -0,0 +1 @@\n+x")], "seq int, text string")
    text = added_lines(split_commits(commits))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("^\\+\\+\\+ (.+)$") == 1 and text.count("commit ([0-9a-f]") == 1


def test_lines_of_a_block_are_spread_for_detection(spark, tmp_path):
    (tmp_path / "r.txt").write_text("diff --git a/p b/p\n--- a/p\n+++ b/p\n@@ -0,0 +1,2 @@\n+x\n+y\n")
    added = read_export(spark, str(tmp_path)).added
    assert "hashpartitioning(_file" in plan(added) and "_salt" in plan(added)
    assert sorted((r.path, r.line_no, r.line) for r in added.collect()) == [("p", 1, "x"), ("p", 2, "y")]
