"""The scan: a source, the rules, the suppression layers, and the report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from keysieve.functions.globs import PathMatcher, path_matcher
from keysieve.functions.joins import salted_lookup
from keysieve.functions.keywords import holds_any
from keysieve.operators.dedup import keep_earliest
from keysieve.operators.detect import FINDING_COLUMNS, detect, detect_texts
from keysieve.operators.files import (
    RANGE,
    SELECTED,
    coverage,
    inspect_files,
    paths_excluded,
    scanned_texts,
    select_files,
    status_counters,
    unread,
)
from keysieve.operators.suppress import DIRECTIVE, apply_baseline, reportable
from keysieve.operators.verify import hash_raw, label
from keysieve.plans import report
from keysieve.sources.exports import read_export
from keysieve.sources.patches import REPO, added_lines, files_touched
from keysieve.sources.rulesets import RuleSet
from keysieve.sources.scratch import materialized
from keysieve.sources.tree import RANGE_BYTES, lines_before, read_ignore, read_selected, scan_root, select_tree


@dataclass(frozen=True)
class ScanResult:
    """``findings`` holds every finding, suppressed ones marked; ``displayed`` what is shown."""

    findings: DataFrame
    summary: DataFrame
    show_suppressed: bool = False
    #: ``(path, status, error)`` of files that could not be read; None where the source has no files.
    unread: DataFrame | None = None

    @property
    def displayed(self) -> DataFrame:
        rows = self.findings if self.show_suppressed else reportable(self.findings)
        return rows.select(*FINDING_COLUMNS, *(c for c in (REPO,) if c in rows.columns))

    def new_findings(self) -> DataFrame:
        """What a new baseline would hold."""
        rows = reportable(self.findings)
        return rows.select(*FINDING_COLUMNS, *(c for c in (REPO,) if c in rows.columns))

    def lines(self, **options) -> DataFrame:
        options.setdefault("show_suppressed", self.show_suppressed)
        return report.report_lines(self.findings, self.summary, **options)

    def json(self) -> DataFrame:
        return report.report_json(self.displayed, self.summary)


def finish(
    findings: DataFrame,
    covered: Callable[[], DataFrame],
    *,
    baseline: DataFrame | None = None,
    status: DataFrame | None = None,
    show_suppressed: bool = False,
    exit_zero: bool = False,
    duration_ms: int | None = 0,
    keep_on_disk: bool = True,
    unread: DataFrame | None = None,
) -> ScanResult:
    """Baseline, labels and summary on top of annotated findings.

    The finished findings are written once, and the summary and every report are
    made from the table; ``keep_on_disk=False`` leaves them a plan that each use
    runs again. What is written holds hashes of secrets, never secrets.
    ``covered`` is asked for coverage after that.
    """
    findings = hash_raw(findings)
    if baseline is not None:
        findings = materialized(findings, "detected") if keep_on_disk else findings
        findings = apply_baseline(findings, baseline, measured=keep_on_disk)
    if status is not None:
        findings = label(findings, status, show_suppressed=show_suppressed)
    if keep_on_disk:
        findings = materialized(findings, "findings")
    covered = covered()
    totals = report.summary(
        findings, covered, show_suppressed=show_suppressed, exit_zero=exit_zero, duration_ms=duration_ms
    )
    return ScanResult(findings, totals, show_suppressed, unread)


def scan_texts(
    texts: DataFrame,
    ruleset: RuleSet,
    *,
    directive: str = DIRECTIVE,
    status: DataFrame | None = None,
    **options,
) -> ScanResult:
    """Scan a table of ``(path, text)``."""
    found = detect_texts(texts, ruleset, directive=directive, keep_raw=status is not None)
    covered = texts.agg(F.count(F.lit(1)).alias("files_scanned"))
    return finish(found, lambda: covered, status=status, **options)


def _scan_inspected(
    files: DataFrame,
    named: DataFrame,
    ruleset: RuleSet,
    *,
    directive: str = DIRECTIVE,
    status: DataFrame | None = None,
    keep_on_disk: bool = True,
    before: DataFrame | None = None,
    **options,
) -> ScanResult:
    """Scan files with a final status; ``named`` has a row per file, without content.

    ``before`` has the lines before each range of the files that are read in ranges.

    With ``keep_on_disk`` the contents are read once: the file counters are
    observed while the findings are written, by tasks that count once each.
    """
    seen = Observation()
    place = ("abs_path", RANGE) if RANGE in files.columns else ()
    watched = files.observe(seen, *status_counters(bool(place))) if keep_on_disk else files
    found = detect_texts(
        scanned_texts(watched), ruleset, directive=directive, keep=place, keep_raw=status is not None
    )
    if before is not None:
        found = numbered_in_file(found, before)

    def covered() -> DataFrame:
        if not keep_on_disk:
            return coverage(files)
        counted = files.sparkSession.createDataFrame([Row(**seen.get)])
        return report.one_row([counted, named.agg(paths_excluded())])

    return finish(found, covered, status=status, keep_on_disk=keep_on_disk, unread=unread(files), **options)


def scan_files(
    manifest: DataFrame,
    ruleset: RuleSet,
    *,
    matcher: PathMatcher | None = None,
    overlapping: bool = True,
    skip_binary: bool = False,
    **options,
) -> ScanResult:
    """Scan a manifest that already holds the content of its files."""
    matcher = matcher or path_matcher((), ruleset.use_default_excludes)
    max_mb = ruleset.max_file_size_mb
    named = select_files(manifest, matcher, max_mb=max_mb, overlapping=overlapping)
    files = inspect_files(named, skip_binary=skip_binary)
    return _scan_inspected(files, named.drop("content"), ruleset, **options)


def scan_tree(
    spark: SparkSession,
    roots: list[str],
    ruleset: RuleSet,
    *,
    ignore: list[str] | None = None,
    default_excludes: bool = True,
    skip_binary: bool = False,
    range_bytes: int = RANGE_BYTES,
    **options,
) -> ScanResult:
    """Scan directory trees; the ignore file of the first root applies.

    A file of more than ``range_bytes`` is scanned by several tasks, in ranges of
    whole lines; its lines are counted in a pass of their own.
    """
    lines = read_ignore(scan_root(roots)) if ignore is None else ignore
    matcher = path_matcher(lines, ruleset.use_default_excludes and default_excludes)
    named = select_tree(spark, roots, matcher, max_mb=ruleset.max_file_size_mb)
    ranged = not named.filter((F.col("status") == SELECTED) & (F.col("size") > range_bytes)).isEmpty()
    files = read_selected(named, skip_binary=skip_binary, range_bytes=range_bytes if ranged else None)
    before = lines_before(named, range_bytes) if ranged else None
    return _scan_inspected(files, named, ruleset, before=before, **options)


def numbered_in_file(found: DataFrame, before: DataFrame) -> DataFrame:
    """Findings of ranges with the line numbers of their files."""
    placed = salted_lookup(found, before, ["abs_path", RANGE], ["line", "column"])
    line = (F.col("line") + F.coalesce("lines_before", F.lit(0))).cast("int")
    return placed.withColumn("line", line).select(*(c for c in found.columns if c not in ("abs_path", RANGE)))


def scan_patches(
    patch_files: DataFrame,
    ruleset: RuleSet,
    *,
    directive: str = DIRECTIVE,
    strict: bool = False,
    show_suppressed: bool = False,
    status: DataFrame | None = None,
    **options,
) -> ScanResult:
    """Scan the lines that commits or a staged diff add.

    No path exclusion and no file policy applies; the same secret in the same
    file of a repository is one finding, placed at its earliest commit.
    """
    return _scan_added(
        added_lines(patch_files), lambda: files_touched(patch_files), ruleset, directive=directive, strict=strict,
        show_suppressed=show_suppressed, status=status, **options,
    )


def scan_export(spark: SparkSession, location: str, ruleset: RuleSet, **options) -> ScanResult:
    """Scan exports of ``git log -p`` or ``git diff --staged``, a file or ``repo=`` folder each.

    The same result as ``scan_patches(read_history(…))``, line by line: a commit
    may be of any size, and lines without a keyword leave their text behind before
    anything is shuffled. Takes the options of :func:`scan_patches`.
    """
    export = read_export(spark, location, lambda line: holds_any(line, ruleset.keywords))
    return _scan_added(export.added, lambda: files_touched(export.files), ruleset, **options)


def _scan_added(
    added: DataFrame,
    touched: Callable[[], DataFrame],
    ruleset: RuleSet,
    *,
    directive: str = DIRECTIVE,
    strict: bool = False,
    show_suppressed: bool = False,
    status: DataFrame | None = None,
    **options,
) -> ScanResult:
    keep_raw = status is not None
    keep = ("seq", *(c for c in (REPO,) if c in added.columns))
    found = detect(added, ruleset, directive=directive, keep=keep, keep_raw=keep_raw)
    kept = keep_earliest(
        hash_raw(found),
        show_suppressed=show_suppressed,
        strict=strict,
        keep=("secret_sha256",) if keep_raw else (),
    )
    return finish(
        kept,
        touched,
        show_suppressed=show_suppressed,
        status=status,
        **options,
    )
