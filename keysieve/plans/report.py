"""What a scan says: counters, verdict, text lines and the JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.functions.text import format_duration, sanitize_text, short_sha
from keysieve.operators.detect import FINDING_COLUMNS
from keysieve.operators.suppress import BASELINE, DIRECTIVE, INLINE, REASONS
from keysieve.sources.scratch import materialized

SORT_COLUMNS = ("file", "line", "column", "rule_id", "fingerprint")
COVERAGE = ("files_scanned", "paths_excluded", "files_unreadable", "files_oversized", "files_binary")
SUMMARY_ORDER = (
    "files_scanned", "finding_count", "duration_ms", "paths_excluded", "suppressed",
    "files_unreadable", "files_oversized", "files_binary",
)
ALWAYS_SHOWN = ("files_scanned", "finding_count", "duration_ms")


# The sentences of the text report.
FOUND = "⚠ %d finding(s) in %d file(s) · scanned %d files · %s"
CLEAN = "✓ no findings · scanned %d files · %s"
OVERSIZED, BINARY, SKIPPED = "%d over --max-file-size", "%d binary", "  (skipped: %s)"
UNREAD = "⚠ %d file(s) could not be scanned — see warnings above; this scan is NOT complete"
HIDDEN, VERIFIED = "  (%d %s)", "Verified: %d active, %d inactive, %d unknown"
COMMIT = "    ↳ commit %s by %s on %s"
ADVICE = "    ↳ suppress: add `// %s` on this line · fingerprint: %s"
INFORMATIONAL = "Suppressed (informational):"


def sort_findings(findings: DataFrame) -> DataFrame:
    """The one total order of findings; text compares bytewise. Repositories come one after another."""
    return findings.orderBy(*(c for c in ("repo",) if c in findings.columns), *SORT_COLUMNS)


def numbered(findings: DataFrame, name: str = "row_no") -> DataFrame:
    """The findings with their place in the total order, from 1.

    Sorted once; the places come from the sizes of the sorted partitions, so no
    task sees all rows. The findings are written before that, because a sort reads
    its input twice: once for the borders of its partitions.
    """
    findings = materialized(findings, "findings")
    part, row = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row")
    ordered = materialized(sort_findings(findings).select("*", part, row), "sorted-findings")
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # a row per partition
    return ordered.join(F.broadcast(starts), "_part").select(
        *findings.columns, (F.col("_before") + F.col("_row") + 1).alias(name)
    )


def _live() -> Column:
    return ~F.coalesce("suppressed", F.lit(False))


def one_row(frames: list[DataFrame]) -> DataFrame:
    """Several one-row frames side by side, without a join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))


def finding_counts(findings: DataFrame) -> DataFrame:
    """One row of counters over all findings, suppressed ones included."""
    status = F.col("verification.status")
    checked = _live() & F.col("verification").isNotNull()
    # a deduplicated row stands for all its suppressed occurrences
    if "inline_hits" in findings.columns:
        inline = F.coalesce(F.sum("inline_hits"), F.lit(0).cast("long"))
    else:
        inline = F.count_if(F.col("suppression_reason") == INLINE)
    file = F.struct("repo", "file") if "repo" in findings.columns else F.col("file")
    return findings.agg(
        F.count_if(_live()).alias("active"),
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.when(_live(), file)).alias("active_files"),
        inline.alias("inline_ignored"),
        F.count_if(F.col("suppression_reason") == BASELINE).alias("baselined"),
        F.count_if(checked & (status == "active")).alias("verified_active"),
        F.count_if(checked & (status == "inactive")).alias("verified_inactive"),
        F.count_if(checked & ~status.isin("active", "inactive")).alias("verified_unknown"),
    )


def summary(
    findings: DataFrame,
    coverage: DataFrame,
    *,
    show_suppressed: bool = False,
    duration_ms: int | None = 0,
    exit_zero: bool = False,
) -> DataFrame:
    """One row: coverage, counts, ``suppressed`` by reason, and the verdict.

    ``coverage`` is one row with ``files_scanned`` and whatever other coverage
    counters the source has. ``finding_count`` counts the displayed rows. The
    verdict is 1 for reportable findings or unreadable files.
    """
    zero = F.lit(0).cast("long")
    row = one_row([finding_counts(findings), coverage])
    row = row.withColumns(
        {name: F.coalesce(name, zero) if name in row.columns else zero for name in COVERAGE}
    )
    reasons = {INLINE: "inline_ignored", BASELINE: "baselined"}
    suppressed = F.map_from_entries(
        F.filter(
            F.array(*(F.struct(F.lit(k).alias("key"), F.col(v).alias("value")) for k, v in reasons.items())),
            lambda entry: entry["value"] > 0,
        )
    )
    failed = (F.col("active") > 0) | (F.col("files_unreadable") > 0)
    return row.select(
        *COVERAGE,
        F.col("total" if show_suppressed else "active").alias("finding_count"),
        F.lit(duration_ms).cast("long").alias("duration_ms"),
        suppressed.alias("suppressed"),
        "active",
        "active_files",
        "verified_active",
        "verified_inactive",
        "verified_unknown",
        (F.lit(0) if exit_zero else F.when(failed, 1).otherwise(0)).alias("verdict"),
    )


def _place(repo: bool) -> Column:
    """``file:line:column``, after the repository's name if there are several."""
    place = F.concat_ws(":", sanitize_text(F.col("file")), F.col("line"), F.col("column"))
    return F.concat(F.coalesce(F.concat(sanitize_text(F.col("repo")), F.lit(" ")), F.lit("")), place) if repo else place


def _finding_line(repo: bool = False) -> Column:
    name = F.concat("rule_id", F.when(F.coalesce("is_heuristic", F.lit(False)), " ?").otherwise(""))
    place = _place(repo)
    has_sha = F.coalesce("commit_sha", F.lit("")) != ""
    commit = F.when(has_sha, F.concat(F.lit(" @ "), sanitize_text(short_sha(F.col("commit_sha")))))
    status = F.col("verification.status")
    tag = F.when(status.isin("active", "inactive"), F.upper(status)).otherwise("UNKNOWN")
    suffix = F.when(F.col("verification").isNotNull(), F.concat(F.lit("  ["), tag, F.lit("]")))
    blank = F.lit("")
    return F.concat(
        place, F.coalesce(commit, blank), F.lit("  "), name, F.lit("  "),
        sanitize_text(F.col("secret")), F.coalesce(suffix, blank),
    )


def _hints(directive: str) -> list[Column]:
    known = F.coalesce("commit_sha", F.lit("")) != ""
    by = F.coalesce("commit_author", F.lit(""))
    on = F.coalesce("commit_date", F.lit(""))
    commit = F.format_string(COMMIT, *(sanitize_text(c) for c in (F.col("commit_sha"), by, on)))
    advice = F.format_string(ADVICE, F.lit(directive), sanitize_text(F.col("fingerprint")))
    return [F.when(known & ((by != "") | (on != "")), commit), advice]


def _suppressed_line(repo: bool = False) -> Column:
    return F.concat(
        F.lit("  ○ "), _place(repo),
        F.lit("  ["), F.col("rule_id"), F.lit("] ("), F.col("suppression_reason"), F.lit(")  "),
        sanitize_text(F.col("secret")),
    )


def summary_lines(totals: DataFrame) -> DataFrame:
    """The closing lines of the text report, in order."""
    found = F.format_string(
        FOUND, "active", "active_files", "files_scanned", format_duration(F.col("duration_ms")),
    )
    clean = F.format_string(
        CLEAN, "files_scanned", format_duration(F.col("duration_ms"))
    )
    skipped = F.concat_ws(
        ", ",
        F.when(F.col("files_oversized") > 0, F.format_string(OVERSIZED, "files_oversized")),
        F.when(F.col("files_binary") > 0, F.format_string(BINARY, "files_binary")),
    )
    unread = F.format_string(UNREAD, "files_unreadable")
    verified = ("verified_active", "verified_inactive", "verified_unknown")
    lines = [
        F.when(F.col("active") > 0, found).otherwise(clean),
        F.when(skipped != "", F.format_string(SKIPPED, skipped)),
        F.when(F.col("files_unreadable") > 0, unread),
        *(
            F.when(
                F.try_element_at("suppressed", F.lit(reason)) > 0,
                F.format_string(HIDDEN, F.try_element_at("suppressed", F.lit(reason)), F.lit(reason)),
            )
            for reason in REASONS
        ),
        F.when(
            sum((F.col(c) for c in verified[1:]), F.col(verified[0])) > 0,
            F.format_string(VERIFIED, *verified),
        ),
    ]
    return totals.select(F.posexplode(F.array(*lines)).alias("part", "value")).filter("value IS NOT NULL")


def report_lines(
    findings: DataFrame,
    totals: DataFrame,
    *,
    show_suppressed: bool = False,
    verbose: bool = False,
    quiet: bool = False,
    directive: str = DIRECTIVE,
) -> DataFrame:
    """The text report: ``section, file, line, column, rule_id, fingerprint, part, value``.

    Sorted by the first seven columns, ``value`` reads as the report.
    """
    keys = [F.col(c) for c in SORT_COLUMNS]

    def lines(rows: DataFrame, section: int, values: list[Column]) -> DataFrame:
        return rows.select(
            F.lit(section).alias("section"), *keys, F.posexplode(F.array(*values)).alias("part", "value")
        ).filter("value IS NOT NULL")

    repo = "repo" in findings.columns
    shown = [_finding_line(repo), *(_hints(directive) if verbose else [])]
    report = lines(findings.filter(_live()), 0, shown)
    keyless = [
        F.lit(None).cast(findings.schema[c].dataType).alias(c) for c in SORT_COLUMNS
    ]
    if show_suppressed:
        hidden = findings.filter(~_live())
        first = hidden.limit(1).select(
            F.lit(1).alias("section"), *keyless,
            F.posexplode(F.array(F.lit(""), F.lit(INFORMATIONAL))).alias("part", "value"),
        )
        report = report.unionByName(first).unionByName(lines(hidden, 2, [_suppressed_line(repo)]))
    if not quiet:
        closing = summary_lines(totals).select(F.lit(3).alias("section"), *keyless, "part", "value")
        report = report.unionByName(closing)
    return report


def sort_report(lines: DataFrame) -> DataFrame:
    """The report in reading order; keep only ``value`` when writing it out."""
    return lines.orderBy("section", *SORT_COLUMNS, "part")


def finding_json(columns: tuple[str, ...] = FINDING_COLUMNS) -> Column:
    """One finding as JSON; absent and false fields are left out."""
    flags = ("is_heuristic", "suppressed")
    fields = [F.when(F.col(c), F.lit(True)).alias(c) if c in flags else F.col(c) for c in columns]
    return F.to_json(F.struct(*fields))


def summary_json() -> Column:
    fields = []
    for name in SUMMARY_ORDER:
        value = F.col(name)
        if name == "suppressed":
            value = F.when(F.size("suppressed") > 0, value)
        elif name not in ALWAYS_SHOWN:
            value = F.when(value > 0, value)
        fields.append(value.alias(name))
    return F.to_json(F.struct(*fields))


def report_json(displayed: DataFrame, totals: DataFrame) -> DataFrame:
    """The JSON document ``{findings, summary}`` as lines ``(section, ..., value)``.

    No row holds more than one finding, so the document may be of any size:
    written in order, the lines are the document. Only the first place in the
    order goes without a comma; findings that share that very place are one line.
    """
    repo = [c for c in ("repo",) if c in displayed.columns]
    order = [*repo, *SORT_COLUMNS]
    keyless = [F.lit(None).cast(displayed.schema[c].dataType).alias(c) for c in order]
    rows = displayed.select(*order, finding_json((*repo, *FINDING_COLUMNS)).alias("value"))
    first = displayed.agg(F.min(F.struct(*order)).alias("_first"))  # one row
    marked = rows.join(F.broadcast(first), F.struct(*order) == F.col("_first"), "left")
    later = marked.filter("_first IS NULL").select(*order, F.concat(F.lit(","), "value").alias("value"))
    opening_rows = marked.filter("_first IS NOT NULL").groupBy(*order).agg(
        F.array_join(F.sort_array(F.collect_list("value")), ",").alias("value")
    )
    body = opening_rows.unionByName(later).select(F.lit(1).alias("section"), *order, "value")
    opening = totals.select(F.lit(0).alias("section"), *keyless, F.lit('{"findings":[').alias("value"))
    closing = totals.select(
        F.lit(2).alias("section"), *keyless,
        F.concat(F.lit('],"summary":'), summary_json(), F.lit("}")).alias("value"),
    )
    return opening.unionByName(body).unionByName(closing)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write report lines as text; the part files, in name order, are the report."""
    order = [c for c in ("section", "repo", *SORT_COLUMNS, "part") if c in lines.columns]
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)
