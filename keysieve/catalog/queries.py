"""The registered queries: every operator on the given tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysieve.catalog import corpus
from keysieve.functions.globs import path_matcher
from keysieve.functions.text import (
    content_key,
    fingerprint,
    redact,
    redact_all,
    redact_at,
    rfc3339,
    sanitize_text,
    secret_hash,
    shannon_entropy,
    short_sha,
)
from keysieve.operators import detect as det
from keysieve.operators import verify
from keysieve.operators.dedup import keep_earliest
from keysieve.operators.files import coverage, file_status, scanned_texts, unread
from keysieve.operators.ignores import ignore_patterns, with_ignored
from keysieve.operators.indexed import build_index, detect_indexed
from keysieve.operators.suppress import apply_baseline, known_findings, new_findings, reportable
from keysieve.plans import report, scan
from keysieve.sources.baseline import read_baseline, write_baseline
from keysieve.sources.patches import added_lines, files_touched, read_history, split_commits
from keysieve.sources.rulesets import (
    PROJECT_FILE,
    RuleSet,
    default_rules,
    load_rules,
    merge_rules,
    read_toml,
    rules_from_table,
    rules_table,
    validate,
)
from keysieve.sources.scratch import materialized, scratch_path
from keysieve.sources.stores import local_path
from keysieve.sources.tree import IGNORE_FILE, list_tree, read_selected, read_tree, select_tree, write_tree
from keysieve.streaming import exports, incremental, keyed

OVERLAY = """
[extend]
use_default = true
disabled_rules = ["jwt", "generic-api-key"]

[[rules]]
id = "github-pat"
description = "classic token, fewer distinct characters allowed"
regex = 'gh[po]_[0-9a-z]{12}'
entropy = 2.5
keywords = ["GHP_", "gho_"]

[[rules]]
id = "labelled-id"
description = "the last id of a list"
regex = 'id(?:[ x]+AKIA([A-Z0-9]{16}))+'
keywords = ["id "]

[[allowlists]]
description = "ids of one kind"
regexes = ['^AKIA[A-F]']
"""
OWN_RULES = """
[[rules]]
id = "own-aws"
description = "ids after a word"
regex = 'id (AKIA[A-Z0-9]{16})'
keywords = ["id AKIA"]
"""
IGNORES = ("# generated", "**/*.env", "!**/config/**/*.env", "svc3/**", "!svc3/src/**", "docs/", "**/lib/d[0-9]*/_f?.*")
FINDING_FIELDS = [c for c in det.FINDING_COLUMNS if c != "verification"]


def rules() -> RuleSet:
    return default_rules()


def merged_rules() -> RuleSet:
    return validate(merge_rules(default_rules(), read_toml(OVERLAY)))


def leak_detections(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return det.detect(corpus.leaks(spark, sf_dir), rules(), **options)


def leak_findings(spark, sf_dir):
    return leak_detections(spark, sf_dir).select(*FINDING_FIELDS)


def doc_findings(spark, sf_dir):
    return det.detect_texts(corpus.documents(spark, sf_dir), rules()).select(*FINDING_FIELDS)


def dense_lines(spark, sf_dir):
    """Lines with a thousand and more matches: many lines of the corpus joined into one."""
    lines = corpus.leaks(spark, sf_dir).withColumn("part", F.floor(F.col("event_id") / 1000))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda r: r["line"]), " ")
    dense = lines.groupBy("part").agg(joined.alias("line"))
    dense = dense.select(F.concat(F.lit("dense/"), F.col("part").cast("string")).alias("path"), F.lit(1).alias("line_no"), "line")
    return det.detect(dense, rules()).select(*FINDING_FIELDS)


def rules_from_table_findings(spark, sf_dir):
    """Detection with rules that were written to a table and read back."""
    kept = rules_from_table(materialized(rules_table(spark, rules()), "rules"))
    stored = RuleSet(rules=kept.rules, allowlists=rules().allowlists)
    found = det.detect(corpus.leaks(spark, sf_dir), stored)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


def indexed_findings(spark, sf_dir):
    """Detection with rules that stay a table: the built-in ones, and one per customer that watches for its account number."""
    own = corpus.table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey + 1000 AS int) AS ordinal", "concat('customer-', c_custkey) AS id", "c_name AS description",
        "concat('[Aa]cct#', c_custkey, '~[0-9]{4}') AS regex", "cast(0 AS double) AS entropy", "array(concat('acct#', c_custkey, '~')) AS keywords",
        "0 AS secret_group", "false AS is_heuristic",
    )
    built_in = rules_table(spark, rules())
    own = own.withColumn("allowlists", F.array().cast(built_in.schema["allowlists"].dataType))
    lines = corpus.leaks(spark, sf_dir)
    watched = F.when(F.col("event_id") % 24 == 21, F.concat("line", F.lit(" Acct#"), F.col("event_id") % 400, F.lit("~"), F.col("event_id") % 9000 + 1000))
    index = build_index(built_in.unionByName(own))
    found = detect_indexed(lines.withColumn("line", F.coalesce(watched, "line")), index, allowlists=rules().allowlists)
    return found.groupBy("rule_id", "secret").agg(F.count(F.lit(1)).alias("findings"))


def keyword_gate(spark, sf_dir):
    lines = det.lines_of(det.gate(corpus.documents(spark, sf_dir), rules(), "text"))
    return det.gate(lines, rules()).select("path", "line_no", F.md5("line").alias("line_md5"))


def rule_candidates(spark, sf_dir):
    tried = det.candidates(corpus.leaks(spark, sf_dir), rules())
    name = det.per_rule(rules(), lambda r: det.quoted(r.id))
    return tried.select("event_id", name.alias("rule_id"))


def _leak_matches(spark, sf_dir):
    return det.matches(corpus.leaks(spark, sf_dir), rules())


def regex_matches(spark, sf_dir):
    return _leak_matches(spark, sf_dir).select(
        "event_id", "rule_id", "column", secret_hash(F.col("raw")).alias("secret_sha256"),
        F.octet_length(F.concat("before", "raw", "after")).alias("match_bytes"),
    )


def entropy_gate(spark, sf_dir):
    return det.entropy_gate(_leak_matches(spark, sf_dir), rules()).select("event_id", "rule_id", "column")


def entropy_off(spark, sf_dir):
    off = rules().with_options(no_entropy=True)
    found = det.detect(corpus.leaks(spark, sf_dir), off)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


def secret_entropy(spark, sf_dir):
    return _leak_matches(spark, sf_dir).select(
        "event_id", "rule_id", "column", F.round(shannon_entropy(F.col("value")), 6).alias("entropy")
    )


def allowlist_filtered(spark, sf_dir):
    found = det.allowlist_filter(_leak_matches(spark, sf_dir), rules())
    return found.select("event_id", "rule_id", "column")


def redacted(spark, sf_dir):
    found = _leak_matches(spark, sf_dir)
    whole = F.concat(F.col("before"), F.col("raw"), F.col("after")).cast("string")
    secret = F.col("value")
    at = F.octet_length("before")
    return found.select(
        "event_id", "rule_id", "column", redact(secret).alias("secret"),
        redact_at(whole, secret, at).alias("by_span"), redact_all(whole, secret).alias("by_search"),
    )


def fingerprints(spark, sf_dir):
    shifted = F.replace(F.col("path"), F.lit("/"), F.lit("\\"))
    return _leak_matches(spark, sf_dir).select(
        "event_id", "rule_id", "column",
        fingerprint(shifted, F.col("rule_id"), F.col("raw")).alias("fingerprint"),
        short_sha(F.col("commit_sha")).alias("short_sha"),
    )


def content_keys(spark, sf_dir):
    keyed = leak_detections(spark, sf_dir).withColumn("content_key", content_key(F.col("fingerprint")))
    return keyed.groupBy("content_key").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("file").alias("files")
    )


def sanitized_text(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select(
        "page_id", sanitize_text(F.col("html")).alias("html"), sanitize_text(F.col("url")).alias("url")
    )


def _paths(spark, sf_dir):
    return corpus.leaks(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


def path_excluded(spark, sf_dir):
    matcher = path_matcher()
    by = matcher.excluded_by(F.col("path"))
    return _paths(spark, sf_dir).select("path", by.isNotNull().alias("excluded"), by.alias("excluded_by"))


def excluded_counts(spark, sf_dir):
    by = path_matcher().excluded_by(F.col("path"))
    rows = _paths(spark, sf_dir).select(F.split("path", "/")[0].alias("service"), by.alias("excluded_by"))
    return rows.groupBy("service").agg(
        F.count_distinct("excluded_by").alias("paths_excluded"), F.count("excluded_by").alias("files_excluded")
    )


def ignore_negation(spark, sf_dir):
    matcher = path_matcher(IGNORES, defaults=False)
    path = F.col("path")
    return _paths(spark, sf_dir).select(
        "path", matcher.file_excluded(path).alias("file_excluded"), matcher(path).alias("excluded")
    )


LIMITS = {"max_mb": 10, "skip_binary": True}


def repos_ignored(spark, sf_dir):
    """Three repositories, two of them with an ignore file of their own."""
    files = corpus.leaks(spark, sf_dir).select(F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("repo"), "path").distinct()
    lines = [("r0", n, line) for n, line in enumerate(IGNORES)] + [("r1", 0, "**/*.go"), ("r1", 1, "!svc2/**"), ("r1", 2, "**/docs/**")]
    patterns = ignore_patterns(spark.createDataFrame(lines, "repo string, ordinal int, line string"))
    found = with_ignored(files, patterns, everywhere=path_matcher((), defaults=False))
    return found.select("repo", "path", F.col("excluded_by").isNotNull().alias("excluded"))


def file_statuses(spark, sf_dir):
    files = file_status(corpus.files(spark, sf_dir), path_matcher(), **LIMITS)
    return files.select("root_ord", "abs_path", "path", "status")


def file_coverage(spark, sf_dir):
    return coverage(file_status(corpus.files(spark, sf_dir), path_matcher(), **LIMITS))


def file_findings(spark, sf_dir):
    files = file_status(corpus.files(spark, sf_dir), path_matcher())
    return det.detect_texts(scanned_texts(files), rules()).select(*FINDING_FIELDS)


def lines_exploded(spark, sf_dir):
    files = file_status(corpus.files(spark, sf_dir), path_matcher((), defaults=False))
    return det.lines_of(scanned_texts(files)).select("path", "line_no", F.md5("line").alias("line_md5"))


def document_lines(spark, sf_dir):
    lines = det.lines_of(corpus.documents(spark, sf_dir))
    return lines.select("path", "line_no", F.md5("line").alias("line_md5"))


def patch_lines(spark, sf_dir):
    return added_lines(corpus.patches(spark, sf_dir)).select(
        "path", "line_no", F.md5("line").alias("line_md5"), "commit_sha", "commit_author", "commit_date"
    )


def files_in_patches(spark, sf_dir):
    patches = corpus.patches(spark, sf_dir)
    gone = F.col("seq") % 3 == 0
    return files_touched(patches.withColumn("new_path", F.when(~gone, F.col("new_path"))))


def _export_rows(spark, sf_dir):
    """A commit per line of the corpus as text: equal paths and secrets in three repositories, and names beyond ASCII."""
    line = corpus.leaks(spark, sf_dir).withColumn("repo", F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")))

    def quoted(side: str):
        odd = F.concat(F.lit(f'"{side}/'), F.replace(F.col("path"), F.lit("docs"), F.lit("d\\303\\266\\tcs")), F.lit('"'))
        return F.when(F.contains("path", F.lit("docs")), odd).otherwise(F.concat(F.lit(f"{side}/"), "path"))

    text = F.concat(
        F.lit("commit "), "commit_sha", F.substring("commit_sha", 1, 8), F.lit("\nAuthor: "), "commit_author",
        F.lit(" <d@e.org>\nDate:   "), "commit_date", F.lit("\n\n    message\n\ndiff --git "), quoted("a"), F.lit(" "), quoted("b"),
        F.lit("\n--- "), quoted("a"), F.lit("\n+++ "), quoted("b"), F.lit("\n@@ -0,0 +"), F.col("line_no").cast("string"),
        F.lit(" @@\n+"), "line",
    )
    return line.select("repo", text.alias("value"))


def _exports(spark, sf_dir):
    """A history export per repository."""
    path = scratch_path(spark, "exports")
    _export_rows(spark, sf_dir).write.partitionBy("repo").text(path)
    return path


def history_many_repos(spark, sf_dir):
    result = scan.scan_patches(read_history(spark, _exports(spark, sf_dir)), rules())
    return result.displayed.select("repo", "file", "rule_id", "secret", "fingerprint", "commit_date")


def repos_summary(spark, sf_dir):
    row = scan.scan_patches(read_history(spark, _exports(spark, sf_dir)), rules()).summary
    return row.select("files_scanned", "finding_count", "active_files")


def _whole_export(spark, sf_dir, headed: bool):
    """One export per repository: a single commit, or staged diff, that adds every line of the corpus."""
    line = corpus.leaks(spark, sf_dir).withColumn("repo", F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")))
    place = ("repo", "path", "line_no", "event_id")
    hunks = line.select(*place, F.concat(F.lit("@@ -0,0 +"), F.col("line_no").cast("string"), F.lit(" @@\n+"), "line").alias("value"))
    names = F.format_string("diff --git a/%1$s b/%1$s\n--- a/%1$s\n+++ b/%1$s", "path")
    files = line.groupBy("repo", "path").agg(F.lit(0).alias("line_no"), F.lit(0).cast("long").alias("event_id"), names.alias("value"))
    head = f"commit {'c' * 40}\nAuthor: First <f@e.org>\nDate:   2024-05-05T05:05:05Z\n\n    all of it\n"
    heads = line.groupBy("repo").agg(F.lit("").alias("path"), F.lit(0).alias("line_no"), F.lit(0).cast("long").alias("event_id"), F.lit(head).alias("value"))
    rows = hunks.unionByName(files)
    rows = rows.unionByName(heads) if headed else rows
    path = scratch_path(spark, "whole-export")
    rows.repartition("repo").sortWithinPartitions(*place).select("repo", "value").write.partitionBy("repo").text(path)
    return path


def history_huge_commit(spark, sf_dir):
    """A commit as large as its repository, read by many tasks."""
    found = scan.scan_export(spark, _whole_export(spark, sf_dir, True), rules()).displayed
    return found.select("repo", "file", "line", "rule_id", "secret", "fingerprint", "commit_sha", "commit_author", "commit_date")


def staged_export(spark, sf_dir):
    """Staged diffs as text, one per repository; what they add and how many files they touch."""
    result = scan.scan_export(spark, _whole_export(spark, sf_dir, False), rules())
    touched = result.summary.select(F.lit(None).cast("string").alias("file"), F.col("files_scanned").alias("n"))
    found = result.displayed.filter("commit_sha IS NULL").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(touched)


def history_findings(spark, sf_dir):
    found = det.detect(added_lines(corpus.patches(spark, sf_dir)), rules())
    return found.select(*FINDING_FIELDS)


def staged_findings(spark, sf_dir):
    staged = corpus.patches(spark, sf_dir).withColumns(
        {c: F.lit(None).cast("string") for c in ("commit_sha", "author", "commit_date")}
    )
    result = scan.scan_patches(staged, rules())
    return result.displayed.select(*FINDING_FIELDS)


def _history(spark, sf_dir):
    return det.detect(added_lines(corpus.patches(spark, sf_dir)), rules(), keep=("seq",))


def history_dedup(spark, sf_dir):
    return keep_earliest(_history(spark, sf_dir)).select(*FINDING_FIELDS, "inline_hits")


def history_dedup_strict(spark, sf_dir):
    return keep_earliest(_history(spark, sf_dir), strict=True).select(*FINDING_FIELDS, "inline_hits")


def inline_suppressed(spark, sf_dir):
    found = leak_detections(spark, sf_dir)
    return found.groupBy("rule_id", "suppression_reason").agg(F.count(F.lit(1)).alias("findings"))


def _baseline(spark, sf_dir):
    """What is known of the lines: the findings of a third of them, a table that is there before the query."""
    third = corpus.leaks(spark, sf_dir).filter("event_id % 3 = 0")
    return corpus.stored(spark, "baseline", sf_dir, lambda: reportable(det.detect(third, rules())))


def _file_baseline(spark, sf_dir):
    """What is known of the files, in the same way."""
    texts = corpus.files(spark, sf_dir).filter("first_id % 3 = 0").selectExpr("path", "cast(content AS string) AS text")
    return corpus.stored(spark, "file-baseline", sf_dir, lambda: reportable(det.detect_texts(texts, rules())))


def baseline_roundtrip(spark, sf_dir):
    """A baseline written as one document and read back."""
    path = scratch_path(spark, "baseline-document")
    write_baseline(leak_detections(spark, sf_dir), path, format="envelope")
    return read_baseline(spark, path, format="envelope").select(*FINDING_FIELDS)


def _stored_baseline(spark, sf_dir):
    """A third of the findings, written as one document and read back."""
    path = scratch_path(spark, "baseline-document")
    write_baseline(_baseline(spark, sf_dir), path, format="envelope")
    return read_baseline(spark, path, format="envelope")


def baseline_applied(spark, sf_dir):
    """A stored document applied to all findings, in a batch and on a stream."""
    known = _stored_baseline(spark, sf_dir)
    batch = new_findings(leak_detections(spark, sf_dir), known).select(F.lit("batch").alias("source"), *FINDING_FIELDS)
    lines = _as_stream(corpus.leaks(spark, sf_dir), "lines")
    path = scratch_path(spark, "stream-new")
    fresh = incremental.stream_new_findings(incremental.stream_findings(lines, rules()), known).select(*FINDING_FIELDS)
    incremental.write_appended(fresh, path, path + "-progress", availableNow=True).awaitTermination()
    streamed = spark.read.schema(fresh.schema).parquet(path)
    return batch.unionByName(streamed.select(F.lit("stream").alias("source"), *FINDING_FIELDS))


def baseline_any_layout(spark, sf_dir):
    """Indented documents, one per eighth of the findings, each cut between tasks."""
    found = reportable(leak_detections(spark, sf_dir, keep=("event_id",)))
    part = (F.col("event_id") % 8).cast("int").alias("part")
    finding = F.to_json(F.struct(*(c for c in det.FINDING_COLUMNS)), {"pretty": "true"})
    comma = F.when(F.lag("part").over(Window.partitionBy("part").orderBy("event_id", "rule_id", "column")).isNotNull(), ",\n").otherwise("")
    body = found.select("*", part).select("part", F.lit(1).alias("section"), "event_id", F.concat(comma, finding).alias("value"))
    ends = spark.range(8).selectExpr("cast(id AS int) AS part", "explode(array(0, 2)) AS section", "0L AS event_id").withColumn(
        "value", F.when(F.col("section") == 0, '{\n  "version": 1,\n  "findings": [').otherwise("  ]\n}")
    )
    path = scratch_path(spark, "baseline-indented")
    rows = body.unionByName(ends).repartition(8, "part").sortWithinPartitions("part", "section", "event_id")
    rows.select("part", "value").write.partitionBy("part").text(path)
    return read_baseline(spark, path, format="envelope").select(*FINDING_FIELDS)


def baseline_many_repos(spark, sf_dir):
    """The stored baseline of one repository hides nothing in the others."""
    lines = corpus.leaks(spark, sf_dir).withColumn("repo", F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")))
    found = det.detect(lines, rules(), keep=("repo",))
    path = scratch_path(spark, "baseline-document")
    write_baseline(found.filter("repo = 'r1'"), path, format="envelope")
    return new_findings(found, read_baseline(spark, path, format="envelope")).select("repo", *FINDING_FIELDS)


def baseline_marked(spark, sf_dir):
    marked = apply_baseline(leak_detections(spark, sf_dir), _baseline(spark, sf_dir))
    return marked.groupBy("rule_id", "suppression_reason").agg(F.count(F.lit(1)).alias("findings"))


def baseline_new(spark, sf_dir):
    return new_findings(leak_detections(spark, sf_dir), _baseline(spark, sf_dir)).select(*FINDING_FIELDS)


def baseline_known(spark, sf_dir):
    return known_findings(leak_detections(spark, sf_dir), _baseline(spark, sf_dir)).select(*FINDING_FIELDS)


def baseline_moved(spark, sf_dir):
    moved = corpus.leaks(spark, sf_dir).selectExpr("concat('moved/', path) AS path", "line_no + 3 AS line_no", "line")
    marked = apply_baseline(det.detect(moved, rules()), _baseline(spark, sf_dir))
    return marked.groupBy("suppression_reason").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("fingerprint").alias("fingerprints")
    )


def rules_merged(spark, sf_dir):
    found = det.detect(corpus.leaks(spark, sf_dir), merged_rules(), keep=("event_id",))
    return found.select("event_id", "rule_id", "column", "match", "secret")


def findings_sorted(spark, sf_dir):
    return report.numbered(leak_findings(spark, sf_dir)).select("row_no", *report.SORT_COLUMNS)


def _file_scan(spark, sf_dir, **options):
    files = corpus.files(spark, sf_dir)
    baseline = _file_baseline(spark, sf_dir)
    limited = rules().with_options(max_file_size_mb=LIMITS["max_mb"])
    return scan.scan_files(files, limited, baseline=baseline, duration_ms=1234, skip_binary=True, **options)


def scan_summary(spark, sf_dir):
    row = _file_scan(spark, sf_dir, show_suppressed=True).summary
    reasons = [F.try_element_at("suppressed", F.lit(r)).alias(r.replace("-", "_")) for r in ("inline-ignore", "baseline")]
    return row.select(*(c for c in row.columns if c not in ("suppressed", "verdict")), *reasons)


def scan_verdict(spark, sf_dir):
    dirty = _file_scan(spark, sf_dir).summary.select(F.lit("files").alias("source"), "verdict", "active")
    texts = corpus.documents(spark, sf_dir)
    found = scan.scan_texts(texts, rules()).summary.select(F.lit("documents").alias("source"), "verdict", "active")
    clean = scan.scan_texts(texts.filter(~F.contains("text", F.lit("="))), rules())
    return dirty.unionByName(found).unionByName(clean.summary.select(F.lit("clean").alias("source"), "verdict", "active"))


def patch_summary(spark, sf_dir):
    row = scan.scan_patches(corpus.patches(spark, sf_dir), rules(), keep_on_disk=False).summary  # nothing but the counts is used
    inline = F.try_element_at("suppressed", F.lit("inline-ignore")).alias("inline_ignore")
    return row.select("files_scanned", "finding_count", "active_files", inline, "verdict")


def report_json(spark, sf_dir):
    return _file_scan(spark, sf_dir, show_suppressed=True).json().select("section", "value")


def report_lines(spark, sf_dir):
    return _file_scan(spark, sf_dir, show_suppressed=True).lines(verbose=True).select("section", "part", "value")


def history_report(spark, sf_dir):
    result = scan.scan_patches(corpus.patches(spark, sf_dir), rules())
    return result.lines(verbose=True).select("section", "part", "value")


def _raw_findings(spark, sf_dir):
    return leak_detections(spark, sf_dir, keep_raw=True)


def probe_set(spark, sf_dir):
    return verify.probe_set(_raw_findings(spark, sf_dir)).select("provider", "secret_sha256")


def _digit(column: str, at: int):
    return F.ascii(F.substring(column, at, 1))


def _github_responses(spark, sf_dir):
    probes = verify.probe_set(_raw_findings(spark, sf_dir)).filter("provider = 'github'")
    each = probes.select("secret_sha256", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    kind = (_digit("secret_sha256", 1) + _digit("secret_sha256", 2) * F.col("attempt")) % 7
    codes = F.array(*(F.lit(c) for c in (200, 401, 429, 403, 403, 500, 200)))
    return each.select(
        "secret_sha256", "attempt", F.get(codes, kind).alias("http_status"),
        (kind == 3).alias("has_retry_after"),
        F.when(_digit("secret_sha256", 3) % 2 == 0, "0").otherwise("12").alias("ratelimit_remaining"),
        ((kind == 6) & (_digit("secret_sha256", 4) % 2 == 0)).alias("transport_error"),
    )


def github_status(spark, sf_dir):
    return verify.github_status(_github_responses(spark, sf_dir))


def _aws_responses(spark, sf_dir):
    probes = verify.probe_set(_raw_findings(spark, sf_dir)).filter("provider = 'aws'")
    kind = (_digit("secret_sha256", 1) + _digit("secret_sha256", 2)) % 8
    codes = F.array(*(F.lit(c) for c in (*verify.AWS_REJECTIONS, "Throttling", None, "ServiceUnavailable")))
    return probes.select(
        "secret_sha256", F.get(codes, kind).alias("error_code"),
        ((kind == 6) & (_digit("secret_sha256", 3) % 2 == 0)).alias("transport_error"),
    )


def aws_status(spark, sf_dir):
    status = verify.aws_status(F.col("error_code"), F.col("transport_error"))
    return _aws_responses(spark, sf_dir).select("secret_sha256", status.alias("status"))


def _status(spark, sf_dir):
    github = github_status(spark, sf_dir).select(F.lit("github").alias("provider"), "secret_sha256", "status")
    aws = aws_status(spark, sf_dir).select(F.lit("aws").alias("provider"), "secret_sha256", "status")
    return materialized(github.unionByName(aws.filter("secret_sha256 < 'c'")), "answers")


def verification_labels(spark, sf_dir):
    labelled = verify.label(_raw_findings(spark, sf_dir), _status(spark, sf_dir), show_suppressed=True)
    return labelled.select(
        "fingerprint", "line", "column", "commit_sha", "suppressed",
        F.col("verification.status").alias("status"), F.col("verification.provider").alias("provider"),
    )


def verification_tally(spark, sf_dir):
    labelled = verify.label(_raw_findings(spark, sf_dir), _status(spark, sf_dir))
    return report.finding_counts(labelled).select(
        "active", "verified_active", "verified_inactive", "verified_unknown"
    )


def _key_files(spark, sf_dir):
    """Files of the corpus with secret keys and hints among their lines."""
    lines = corpus.leaks(spark, sf_dir)
    token = F.concat(F.col("commit_sha"), F.substring(F.md5("path"), 1, 8))
    extra = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("\nkey "), token, F.lit(";")))
        .when(F.col("event_id") % 4 == 1, F.lit("\nAWS_SECRET_ACCESS_KEY follows"))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("\nblob "), token, F.lit("abcdef"), F.lit("\n\n'"), F.lower(token), F.lit("'")))
        .otherwise(F.lit(""))
    )
    part = F.concat(F.lit("keys/k"), F.floor(F.col("event_id") / 12).cast("string"))
    rows = lines.select(part.alias("path"), "event_id", F.concat(F.col("line"), extra).alias("text"))
    grouped = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("event_id", "text"))).alias("rows"))
    return grouped.select("path", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def aws_pairing(spark, sf_dir):
    return verify.pair_secret_keys(_key_files(spark, sf_dir))


def aws_key_pairs(spark, sf_dir):
    texts = _key_files(spark, sf_dir)
    found = det.detect_texts(texts, rules(), keep_raw=True)
    pairs = verify.aws_pairs(found, texts)
    return pairs.select(secret_hash(F.col("raw")).alias("secret_sha256"), "path", "token")


def _as_stream(frame: DataFrame, name: str) -> DataFrame:
    """The rows written as a table, and that table as a stream."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 4).parquet(path)


def stream_findings(spark, sf_dir):
    lines = _as_stream(corpus.leaks(spark, sf_dir), "lines")
    path = scratch_path(spark, "stream-findings")
    found = incremental.stream_findings(lines, rules()).select(*FINDING_FIELDS)
    incremental.write_appended(found, path, path + "-progress", availableNow=True).awaitTermination()
    return spark.read.schema(found.schema).parquet(path)


def stream_new_findings(spark, sf_dir):
    lines = _as_stream(corpus.leaks(spark, sf_dir), "lines")
    path = scratch_path(spark, "stream-new")
    found = incremental.stream_findings(lines, rules())
    fresh = incremental.stream_new_findings(found, _baseline(spark, sf_dir)).select(*FINDING_FIELDS)
    incremental.write_appended(fresh, path, path + "-progress", availableNow=True).awaitTermination()
    return spark.read.schema(fresh.schema).parquet(path)


def stream_dedup(spark, sf_dir):
    lines = _as_stream(added_lines(corpus.patches(spark, sf_dir)), "patch-lines")
    path = scratch_path(spark, "stream-dedup")
    found = incremental.stream_findings(lines, rules(), keep=("seq",))
    earliest = incremental.stream_earliest(found)
    incremental.write_changes(earliest, path, path + "-progress", availableNow=True).awaitTermination()
    return incremental.latest_rows(spark, path).select(*FINDING_FIELDS)


def stream_dedup_expiring(spark, sf_dir):
    """Deduplication whose state expires; the merged table holds the rows."""
    lines = _as_stream(added_lines(corpus.patches(spark, sf_dir)), "patch-lines")
    path = scratch_path(spark, "stream-merged")
    parts = keyed.stream_parts(incremental.stream_findings(lines, rules(), keep=("seq",)), idle_ms=1)
    keyed.write_merged(parts, path, path + "-progress", every=2, availableNow=True).awaitTermination()
    return keyed.merged_rows(spark, path).select(*FINDING_FIELDS)


def stream_growing_baseline(spark, sf_dir):
    """A stream with no baseline at first; the second half of the lines meets one."""
    lines = corpus.leaks(spark, sf_dir)
    source, base, out = (scratch_path(spark, name) for name in ("lines", "growing-baseline", "stream-new"))
    for half in (0, 1):
        lines.filter(f"event_id % 2 = {half}").write.mode("append").parquet(source)
        found = incremental.stream_findings(spark.readStream.schema(lines.schema).parquet(source), rules()).select(*FINDING_FIELDS)
        keyed.write_new(found, base, out, out + "-progress", availableNow=True).awaitTermination()
        if half == 0:
            keyed.add_known(_baseline(spark, sf_dir), base)
    return spark.read.parquet(out).select(*FINDING_FIELDS)


def stream_export(spark, sf_dir):
    """A stream over a folder of exports, which gets more files between two runs of the query."""
    exports.register(spark)
    path, out = scratch_path(spark, "growing-exports"), scratch_path(spark, "stream-export")
    rows = _export_rows(spark, sf_dir).withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2)))
    for half in (0, 1):
        rows.filter(F.col("half") == half).select("value").repartition(4).write.mode("append").text(path)
        commits = spark.readStream.format(exports.NAME).option("closed", "true").load(path)
        found = incremental.stream_findings(added_lines(split_commits(commits)), rules())
        query = incremental.write_appended(found.select(*FINDING_FIELDS), out, out + "-progress", processingTime="0 seconds")
        query.processAllAvailable()
        query.stop()
    found = spark.read.schema(found.select(*FINDING_FIELDS).schema).parquet(out)
    return found.groupBy("rule_id", "file").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("commit_sha").alias("commits"))


def _tree(spark, sf_dir):
    texts = corpus.files(spark, sf_dir).filter("root_ord < 2 AND error IS NULL")
    root = local_path(scratch_path(spark, "tree-root"))
    write_tree(texts.selectExpr("path", "cast(content AS string) AS text"), root)
    return root


def tree_findings(spark, sf_dir):
    root = _tree(spark, sf_dir)
    files = read_tree(spark, [root, os.path.join(root, "svc1")], path_matcher(), skip_binary=True)
    return det.detect_texts(scanned_texts(files), rules()).select(*FINDING_FIELDS)


def tree_coverage(spark, sf_dir):
    root = _tree(spark, sf_dir)
    return coverage(read_tree(spark, [root, os.path.join(root, "svc1")], path_matcher(), skip_binary=True))


def tree_unread(spark, sf_dir):
    """Files that vanish between listing and reading are named with the reason."""
    root = _tree(spark, sf_dir)
    chosen = select_tree(spark, [root], path_matcher())
    gone = corpus.files(spark, sf_dir).filter("root_ord < 2 AND error IS NULL AND first_id % 13 IN (8, 9)").select("path")

    def remove(rows) -> None:
        for row in rows:
            os.remove(os.path.join(root, row["path"]))

    gone.foreachPartition(remove)
    return unread(read_selected(chosen))


def tree_manifest(spark, sf_dir):
    entries = list_tree(spark, [_tree(spark, sf_dir)], path_matcher())
    return entries.select("path", "folder", F.coalesce("size", F.lit(-1)).alias("size"))


def tree_large_files(spark, sf_dir):
    """Files of a thousand lines, each scanned in ranges by several tasks."""
    lines = corpus.leaks(spark, sf_dir).withColumn("part", F.floor(F.col("event_id") / 1000).cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda r: r["line"]), "\n")
    texts = lines.groupBy(F.concat(F.lit("big/p"), "part", F.lit(".txt")).alias("path")).agg(text.alias("text"))
    root = local_path(scratch_path(spark, "large-files"))
    write_tree(texts, root)
    return scan.scan_tree(spark, [root], rules(), range_bytes=8192).displayed.select(*FINDING_FIELDS)


def _put(root: str, name: str, text: str) -> None:
    with open(os.path.join(root, name), "w", encoding="utf-8") as file:
        file.write(text)


def tree_ignored(spark, sf_dir):
    """A tree with an ignore file at its root, every file scanned whole."""
    root = _tree(spark, sf_dir)
    _put(root, IGNORE_FILE, "\n".join(IGNORES) + "\n")
    found = scan.scan_tree(spark, [root], rules(), default_excludes=False)
    return found.displayed.select(*FINDING_FIELDS)


def project_rules(spark, sf_dir):
    """Which rules apply: an explicit file, else the project's, which need not extend the built-in ones."""
    root = local_path(scratch_path(spark, "project"))
    os.makedirs(root)
    built_in = load_rules(root=root)
    _put(root, PROJECT_FILE, OWN_RULES)
    _put(root, "other.toml", OVERLAY)
    sets = {"built-in": built_in, "project": load_rules(root=root), "explicit": load_rules(os.path.join(root, "other.toml"), root=root)}
    lines = corpus.leaks(spark, sf_dir)
    each = [
        det.detect(lines, ruleset).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("source"), "*")
        for name, ruleset in sets.items()
    ]
    return each[0].unionByName(each[1]).unionByName(each[2])


def commit_times(spark, sf_dir):
    events = corpus.table(spark, sf_dir, "events")
    return events.select("event_id", rfc3339(F.col("ts")).alias("commit_date"))


QUERIES = {
    name: globals()[name]
    for name in (
        "leak_findings", "doc_findings", "dense_lines", "rules_from_table_findings", "indexed_findings", "keyword_gate", "rule_candidates",
        "regex_matches", "entropy_gate", "entropy_off", "secret_entropy", "allowlist_filtered",
        "redacted", "fingerprints", "content_keys", "sanitized_text", "path_excluded",
        "excluded_counts", "ignore_negation", "repos_ignored", "file_statuses", "file_coverage", "file_findings",
        "lines_exploded", "document_lines", "patch_lines", "files_in_patches", "history_findings",
        "staged_findings", "history_dedup", "history_dedup_strict", "history_many_repos", "history_huge_commit", "staged_export",
        "repos_summary",
        "inline_suppressed", "baseline_roundtrip",
        "baseline_applied", "baseline_any_layout", "baseline_many_repos", "baseline_marked", "baseline_new", "baseline_known", "baseline_moved", "rules_merged",
        "findings_sorted", "scan_summary", "scan_verdict", "patch_summary", "report_json",
        "report_lines", "history_report", "probe_set", "verification_labels", "verification_tally",
        "github_status", "aws_status", "aws_pairing", "aws_key_pairs", "stream_findings",
        "stream_new_findings", "stream_dedup", "stream_dedup_expiring", "stream_growing_baseline", "stream_export",
        "tree_findings", "tree_coverage", "tree_manifest",
        "tree_unread", "tree_large_files", "tree_ignored", "project_rules", "commit_times",
    )
}
