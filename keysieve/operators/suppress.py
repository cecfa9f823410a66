"""Suppression: directives on the line, and a baseline of known findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.functions.joins import SALTS, hot_keys, salted_lookup
from keysieve.functions.regex import portable
from keysieve.functions.text import content_key

DIRECTIVE = "scan:ignore"
REPO = "repo"
# The reasons a finding record may carry.
INLINE = "inline-ignore"
BASELINE = "baseline"
REASONS = (INLINE, "allowlist", BASELINE)


def _directive_pattern(directive: str) -> str:
    return portable(rf"(?i)\Q{directive}\E\b(:[a-zA-Z0-9_,-]+)?")


def first_directive(line: Column, directive: str = DIRECTIVE) -> Column:
    """The first directive on a line with its scope, or the empty string."""
    return F.regexp_extract(line, _directive_pattern(directive), 0)


def inline_suppressed(line: Column, rule_id: Column, directive: str = DIRECTIVE) -> Column:
    """True when the line's first directive names the rule, or names none."""
    return in_scope(first_directive(line, directive), rule_id, directive)


def in_scope(found: Column, rule_id: Column, directive: str = DIRECTIVE) -> Column:
    """True when a directive that was found names the rule, or names none.

    The scope is a list of rule ids compared as written; a bare trailing colon
    is no scope.
    """
    scope = F.substr(found, F.lit(len(directive) + 2))
    return (found != "") & ((scope == "") | F.array_contains(F.split(scope, ","), rule_id))


def baseline_keys(baseline: DataFrame) -> DataFrame:
    """The distinct content keys of a baseline's findings; empty fingerprints do not count.

    With a ``repo`` column, a finding is known in its own repository only.

    A content key is a function of its fingerprint, so "same fingerprint or
    same content key" is membership of the content key alone: one equi-join.
    """
    keys = baseline.filter(F.col("fingerprint") != "")
    repo = [c for c in (REPO,) if c in baseline.columns]
    return keys.select(*repo, content_key(F.col("fingerprint")).alias("content_key")).distinct()


def mark_known(
    findings: DataFrame, baseline: DataFrame, *, salts: int = SALTS, any_repo: bool = False, measured: bool = False
) -> DataFrame:
    """Adds ``known``: whether the baseline holds the finding's content key.

    Findings of several repositories need a baseline that names them: without, the
    known secret of one would hide the same secret in all others. ``any_repo`` asks
    for just that. One leaked key may own a large share of all findings, hence the
    salted join. ``measured`` looks for such keys first, in a pass over the findings,
    which should be a table; only they are spread, and the baseline is shuffled once.
    """
    keyed = findings.withColumn("content_key", content_key(F.col("fingerprint")))
    on = ["content_key"]
    if REPO in findings.columns and not any_repo:
        if REPO not in baseline.columns:
            raise ValueError(f"the findings have a {REPO} column and the baseline has none; any_repo=True ignores repositories")
        on = [REPO, "content_key"]
    keys = baseline_keys(baseline.drop(*({REPO} - set(on)))).withColumn("known", F.lit(True))
    place = ["file", "line", "column", "commit_sha"]
    hot = hot_keys(keyed, on) if measured else None
    marked = salted_lookup(keyed, keys, on, place, salts, hot)
    return marked.withColumn("known", F.coalesce("known", F.lit(False))).select(*findings.columns, "known")


def apply_baseline(findings: DataFrame, baseline: DataFrame, **options) -> DataFrame:
    """Mark known findings suppressed; a directive on the line keeps its reason."""
    columns = findings.columns
    marked = mark_known(findings, baseline, **options)
    fresh = F.col("known") & ~F.coalesce("suppressed", F.lit(False))
    return marked.withColumns(
        {
            "suppressed": F.when(fresh, F.lit(True)).otherwise(F.col("suppressed")),
            "suppression_reason": F.when(fresh, F.lit(BASELINE)).otherwise(F.col("suppression_reason")),
        }
    ).select(*columns)


def reportable(findings: DataFrame) -> DataFrame:
    """What no layer suppressed."""
    return findings.filter(~F.coalesce("suppressed", F.lit(False)))


def new_findings(findings: DataFrame, baseline: DataFrame, **options) -> DataFrame:
    return mark_known(findings, baseline, **options).filter(~F.col("known")).drop("known")


def known_findings(findings: DataFrame, baseline: DataFrame, **options) -> DataFrame:
    return mark_known(findings, baseline, **options).filter("known").drop("known")
