"""Baselines: a snapshot of redacted findings that are already known."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.operators.detect import FINDING_COLUMNS, VERIFICATION_TYPE
from keysieve.operators.suppress import REPO, reportable
from keysieve.plans.report import SORT_COLUMNS, finding_json, numbered
from keysieve.sources.json_records import array_records

FINDING_TYPES = {
    "line": "int", "column": "int", "is_heuristic": "boolean", "suppressed": "boolean",
    "verification": VERIFICATION_TYPE,
}
FINDING_SCHEMA = ", ".join(f"`{c}` {FINDING_TYPES.get(c, 'string')}" for c in FINDING_COLUMNS)
STORED_SCHEMA = f"{FINDING_SCHEMA}, `{REPO}` string"
ENVELOPE_SCHEMA = f"version int, findings array<struct<{STORED_SCHEMA.replace('` ', '`: ')}>>"


def empty_baseline(spark: SparkSession) -> DataFrame:
    """No findings of any repository."""
    return spark.createDataFrame([], STORED_SCHEMA)


# The lines of an envelope, version 1.
LAID_OUT = r'^(\{"version":1,"findings":\[|\]\}|,?\{"rule_id":.*\}|)$'
OPENING, CLOSING = '{"version":1,"findings":[', "]}"


# How a document may begin before its findings and end after them, plain members besides allowed.
_PLAIN = r'\s*"[^"\\]*"\s*:\s*(?:-?\d+|"[^"\\]*"|true|false|null)\s*'
HEAD = rf'^\s*\{{(?:{_PLAIN},)*\s*"findings"\s*:\s*\[\s*(?=\{{)'
TAIL = rf"^\s*\](?:\s*,{_PLAIN})*\s*\}}\s*$"
BETWEEN = r"^\s*,\s*(?=\{)"


def _is_missing(problem: AnalysisException) -> bool:
    return (problem.getCondition() or "").startswith("PATH_NOT_FOUND")


def _parsed(text: Column) -> Column:
    return F.from_json(text, STORED_SCHEMA, {"mode": "FAILFAST"})


def _laid_out(lines: DataFrame) -> DataFrame:
    """Findings of documents that have one finding per line.

    The other lines are left out inside the expression as well: a filter on its
    result may be moved below the filter on the lines.
    """
    value = F.col("value")
    other = value.isin(OPENING, CLOSING, "")
    finding = F.when(~other, _parsed(F.regexp_replace(value, "^,", "")))
    return lines.filter(~other).select(finding.alias("f")).select("f.*")


def _any_layout(spark: SparkSession, path: str) -> DataFrame | None:
    """Findings of documents in any layout, each cut into its findings; None if one is of another form."""
    records = array_records(spark, path)
    first, text = F.col("number") == 0, F.col("text")
    odd = (F.col("last") & (first | ~text.rlike(TAIL))) | (first & ~F.col("last") & ~text.rlike(HEAD))
    by_file = records.groupBy("file").agg(F.bool_or(odd).alias("odd"), F.bool_or("last").alias("closed"))
    if by_file.isEmpty() or not by_file.filter("odd OR NOT closed").limit(1).isEmpty():
        return None
    broken = F.raise_error(F.concat(F.lit("malformed baseline: "), F.substring(text, 1, 80))).cast("string")
    body = F.when(first, F.regexp_replace(text, HEAD, "")).when(text.rlike(BETWEEN), F.regexp_replace(text, BETWEEN, ""))
    finding = F.when(~F.col("last"), _parsed(F.coalesce(body, broken)))
    return records.filter(~F.col("last")).select(finding.alias("f")).select("f.*")


def _with_repo_if_any(rows: DataFrame) -> DataFrame:
    """Without the column of repositories if there are findings and none names one."""
    unnamed = not rows.limit(1).isEmpty() and rows.filter(F.col(REPO).isNotNull()).limit(1).isEmpty()
    return rows.drop(REPO) if unnamed else rows


def read_baseline(spark: SparkSession, path: str, *, format: str | None = None) -> DataFrame:
    """The findings of a baseline, with a ``repo`` column if they name repositories.

    ``format`` is ``envelope`` (JSON documents, the default for a path ending in
    .json), or ``parquet`` or ``json`` for a folder of records. A missing path is
    an empty baseline, the first run; a malformed one an error. Documents are read
    by many tasks, one finding per line as :func:`write_baseline` lays them out, or
    indented or unbroken. Several files of such another layout are a document each.
    Documents without findings, and those whose other members hold objects or arrays,
    are parsed whole.
    """
    format = format or ("envelope" if path.endswith(".json") else "parquet")
    strict = spark.read.option("mode", "FAILFAST")
    try:
        if format != "envelope":
            return _with_repo_if_any(strict.schema(STORED_SCHEMA).format(format).load(path))
        lines = spark.read.text(path)
        if lines.isEmpty():
            found = None
        elif lines.filter(~F.col("value").rlike(LAID_OUT)).limit(1).isEmpty():
            found = _laid_out(lines)
        else:
            found = _any_layout(spark, path)
    except AnalysisException as problem:
        if _is_missing(problem):
            return empty_baseline(spark)
        raise
    if found is None:
        document = strict.schema(ENVELOPE_SCHEMA).option("multiLine", True).json(path)
        found = document.select(F.inline("findings"))
    return _with_repo_if_any(found)


def write_baseline(findings: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Write the reportable, redacted findings as a folder of records.

    As ``envelope``, the part files are, one after another by name, one JSON
    document with a finding per line in the total order. Findings of several
    repositories keep their ``repo``, in either format.
    """
    rows = reportable(findings).select(*FINDING_COLUMNS, *(c for c in (REPO,) if c in findings.columns))
    if format != "envelope":
        rows.write.mode("overwrite").format(format).save(path)
        return
    order = [*(c for c in (REPO,) if c in rows.columns), *SORT_COLUMNS]
    first = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order]
    frame = rows.sparkSession.range(1)
    body = numbered(rows).select(
        F.lit(1).alias("section"), *order,
        F.concat(F.when(F.col("row_no") > 1, ",").otherwise(""), finding_json(tuple(rows.columns))).alias("value"),
    )
    opening = frame.select(F.lit(0).alias("section"), *first, F.lit(OPENING).alias("value"))
    closing = frame.select(F.lit(2).alias("section"), *first, F.lit(CLOSING).alias("value"))
    document = opening.unionByName(body).unionByName(closing)
    document.orderBy("section", *order).select("value").write.mode("overwrite").text(path)
