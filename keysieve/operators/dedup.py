"""One finding per fingerprint, placed where the secret first appeared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.operators.detect import FINDING_COLUMNS
from keysieve.sources.patches import REPO

PLACE = ("line", "column", "commit_sha", "commit_author", "commit_date")
SHOWN = tuple(c for c in FINDING_COLUMNS if c not in PLACE and c != "fingerprint")


def keep_earliest(
    findings: DataFrame,
    *,
    order: str = "seq",
    show_suppressed: bool = True,
    strict: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Collapse occurrences of the same secret in the same file of the same repository.

    ``order`` numbers the patches as they were read, newest commit first. The
    text shown is that of the first occurrence read; line, column and commit
    are those of the earliest commit date, compared as text. ``strict``
    compares dates as points in time, and calls a finding suppressed only when
    all its occurrences are.

    Adds ``inline_hits``, the suppressed occurrences that went into the row.
    Without ``show_suppressed`` they are only counted: a row still marked
    suppressed stands for a fingerprint with no other occurrence. The columns
    named in ``keep`` depend on the secret alone and are carried along. With a
    ``repo`` column, equal fingerprints of two repositories are two findings.

    A plain aggregation: a secret copied into a million commits is reduced
    before the shuffle, and the same code keeps state on a stream.
    """
    each = occurrences(findings, order=order, show_suppressed=show_suppressed, strict=strict, keep=keep)
    return rows_of(merged(each), keep=keep)


def occurrences(
    findings: DataFrame,
    *,
    order: str = "seq",
    show_suppressed: bool = True,
    strict: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per finding for :func:`merged`: what is shown and where it is placed, each with what decides.

    ``([repo], fingerprint, seen, shown, placed, place, hits)``; the smallest
    ``seen`` gives ``shown``, the smallest ``placed`` gives ``place``.
    """
    hidden = F.coalesce("suppressed", F.lit(False))
    seen = F.struct(F.col(order), F.col("line"), F.col("column"))
    dated = F.nullif("commit_date", F.lit(""))
    when = F.to_timestamp(dated) if strict else dated
    placed = F.struct(when.isNull().alias("undated"), when.alias("date"), seen.alias("seen"))
    if strict or not show_suppressed:
        seen = F.struct(hidden.alias("hidden"), seen.alias("seen"))
    if not show_suppressed:
        placed = F.struct(hidden.alias("hidden"), placed.alias("placed"))
    repo = [c for c in (REPO,) if c in findings.columns]
    return findings.select(
        *repo, "fingerprint", seen.alias("seen"), F.struct(*SHOWN, *keep).alias("shown"),
        placed.alias("placed"), F.struct(*PLACE).alias("place"), hidden.cast("long").alias("hits"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Occurrences, or what was merged before, as one row per fingerprint; a null ``seen`` or ``placed`` decides nothing."""
    repo = [c for c in (REPO,) if c in parts.columns]
    return parts.groupBy(*repo, "fingerprint").agg(
        F.min("seen").alias("seen"),
        F.min_by("shown", "seen").alias("shown"),
        F.min("placed").alias("placed"),
        F.min_by("place", "placed").alias("place"),
        F.sum("hits").alias("hits"),
    )


def rows_of(merged_rows: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Finding records of merged occurrences."""
    columns = [
        F.col("fingerprint")
        if name == "fingerprint"
        else F.col(f"{'place' if name in PLACE else 'shown'}.{name}").alias(name)
        for name in FINDING_COLUMNS
    ]
    kept = [F.col(f"shown.{name}").alias(name) for name in keep]
    repo = [c for c in (REPO,) if c in merged_rows.columns]
    return merged_rows.select(*columns, F.col("hits").alias("inline_hits"), *kept, *repo)
