"""Live-status labelling: what to probe, how to read the answers, who gets the label.

Calling the providers is left to whoever holds the network: these operators
produce the distinct probes, classify logged answers, and join the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.functions.joins import salted_lookup
from keysieve.functions.regex import parse, portable
from keysieve.functions.text import secret_hash
from keysieve.operators.suppress import reportable

# Rules with a checker, outcomes, and the answers that decide them.
AWS, GITHUB = "aws", "github"
PROVIDERS = {
    "aws-access-token": AWS,
    "github-pat": GITHUB,
    "github-oauth": GITHUB,
    "github-app-token": GITHUB,
    "github-refresh-token": GITHUB,
    "github-fine-grained-pat": GITHUB,
}
ACTIVE, INACTIVE, UNKNOWN = "active", "inactive", "unknown"
AWS_REJECTIONS = (
    "InvalidClientTokenId",
    "SignatureDoesNotMatch",
    "ExpiredToken",
    "AccessDenied",
    "InvalidSignatureException",
)
SECRET_KEY = "(?:^|[^A-Za-z0-9/+])([A-Za-z0-9/+]{40})(?:[^A-Za-z0-9/+]|$)"
SECRET_KEY_HINT = "(?i)(aws.{0,20}secret|secret_access_key|secretaccesskey)"


def provider_of(rule_id: Column) -> Column:
    """The provider that can check the rule's secrets, or null."""
    found = F.lit(None).cast("string")
    for provider in sorted(set(PROVIDERS.values())):
        rules = [rule for rule, name in PROVIDERS.items() if name == provider]
        found = F.when(rule_id.isin(rules), F.lit(provider)).otherwise(found)
    return found


def probe_set(findings: DataFrame) -> DataFrame:
    """One row per provider and secret among the reportable findings.

    Needs findings with their ``raw`` secret; the result holds raw secrets and
    is for the checker only, never for a report.
    """
    probes = reportable(findings).select(provider_of(F.col("rule_id")).alias("provider"), "raw")
    probes = probes.filter(F.col("provider").isNotNull() & (F.octet_length("raw") > 0)).distinct()
    return probes.select("provider", secret_hash(F.col("raw")).alias("secret_sha256"), "raw")


def hash_raw(findings: DataFrame) -> DataFrame:
    """The findings with the hash of their secret in place of the secret."""
    if "raw" not in findings.columns:
        return findings
    return findings.withColumn("secret_sha256", secret_hash(F.col("raw"))).drop("raw")


def label(findings: DataFrame, status: DataFrame, *, show_suppressed: bool = False) -> DataFrame:
    """Set ``verification`` from a table ``(provider, secret_sha256, status)``.

    Only reportable findings of checkable rules are labelled; without an answer
    they are unknown. With ``show_suppressed`` a suppressed finding takes the
    label of a reportable one with the same fingerprint. Needs the ``raw``
    secret, or its ``secret_sha256``; both are dropped.
    """
    findings = hash_raw(findings)
    columns = [c for c in findings.columns if c != "secret_sha256"]
    place = ["file", "line", "column", "commit_sha"]
    answers = status.groupBy("provider", "secret_sha256").agg(F.min("status").alias("_status"))
    keyed = findings.withColumns(
        {
            "provider": provider_of(F.col("rule_id")),
            "_live": ~F.coalesce("suppressed", F.lit(False)),
        }
    )
    found = salted_lookup(keyed, answers, ["provider", "secret_sha256"], place)
    eligible = F.col("_live")
    if show_suppressed:
        twins = keyed.filter("_live").select("fingerprint").distinct()
        found = salted_lookup(
            found, twins.withColumn("_twin", F.lit(True)), ["fingerprint"], place
        )
        eligible = eligible | F.coalesce("_twin", F.lit(False))
    verdict = F.struct(
        F.coalesce("_status", F.lit(UNKNOWN)).alias("status"), F.col("provider").alias("provider")
    )
    checked = F.when(eligible & F.col("provider").isNotNull(), verdict)
    return found.withColumn("verification", checked).select(*columns)


def aws_status(error_code: Column, transport_error: Column) -> Column:
    """No error is active, a definitive rejection inactive, anything else unknown."""
    return (
        F.when(F.coalesce(transport_error, F.lit(False)), UNKNOWN)
        .when(error_code.isNull(), ACTIVE)
        .when(error_code.isin(*AWS_REJECTIONS), INACTIVE)
        .otherwise(UNKNOWN)
    )


def github_status(responses: DataFrame) -> DataFrame:
    """``(secret_sha256, status)`` from logged answers to at most two attempts.

    A rate limit (429, or 403 with a Retry-After or no remaining quota) calls
    for the second attempt; if that is limited too, or missing, the outcome is
    unknown.
    """
    code = F.col("http_status")
    limited = (code == 429) | (
        (code == 403)
        & (
            F.coalesce("has_retry_after", F.lit(False))
            | F.coalesce(F.col("ratelimit_remaining") == "0", F.lit(False))
        )
    )
    outcome = (
        F.when(F.coalesce("transport_error", F.lit(False)), UNKNOWN)
        .when(code == 200, ACTIVE)
        .when(code == 401, INACTIVE)
        .when(limited, F.lit("retry"))
        .otherwise(UNKNOWN)
    )
    attempts = responses.withColumn("_outcome", outcome).groupBy("secret_sha256").agg(
        *(
            F.min(F.when(F.col("attempt") == n, F.col("_outcome"))).alias(f"_try{n}")
            for n in (1, 2)
        )
    )
    first, second = F.col("_try1"), F.col("_try2")
    status = (
        F.when(first != "retry", first)
        .when((first == "retry") & (second != "retry"), second)
        .otherwise(UNKNOWN)
    )
    return attempts.select("secret_sha256", status.alias("status"))


def pair_secret_keys(texts: DataFrame) -> DataFrame:
    """``(path, token)``: per file, the 40-character token nearest to a hint line.

    A tie goes to the first token in the file; without a hint there is no pair.
    One pass over the lines of a row, nothing shuffled: the nearest token and hint
    have no other of either kind between them, so the last of each is enough.
    """
    worth = texts.select("path", "text").filter(
        F.col("text").rlike(portable(SECRET_KEY_HINT)) & F.col("text").rlike("[A-Za-z0-9/+]{40}")
    )
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, at: F.struct(
            at.alias("at"),
            line.rlike(portable(SECRET_KEY_HINT)).alias("hint"),
            F.nullif(F.regexp_extract(line, parse(SECRET_KEY).capture(1), 1), F.lit("")).alias("token"),
        ),
    )
    kept = F.filter(lines, lambda line: line["hint"] | line["token"].isNotNull())
    empty = "named_struct('gap', cast(NULL AS int), 'at', cast(NULL AS int), 'token', cast(NULL AS string))"
    start = F.expr(
        f"named_struct('hint', cast(NULL AS int), 'at', cast(NULL AS int), 'token', cast(NULL AS string), 'best', {empty})"
    )

    def step(state: Column, line: Column) -> Column:
        hint = F.when(line["hint"], line["at"]).otherwise(state["hint"])
        at = F.when(line["token"].isNotNull(), line["at"]).otherwise(state["at"])
        token = F.coalesce(line["token"], state["token"])
        pair = F.struct(F.abs(at - hint).alias("gap"), at.alias("at"), token.alias("token"))
        better = (at.isNotNull() & hint.isNotNull()) & (
            state["best"]["gap"].isNull() | (pair["gap"] < state["best"]["gap"])
        )
        best = F.when(better, pair).otherwise(state["best"])
        return F.struct(hint.alias("hint"), at.alias("at"), token.alias("token"), best.alias("best"))

    nearest = F.aggregate(kept, start, step, lambda state: state["best"]["token"])
    return worth.select("path", nearest.alias("token")).filter("token IS NOT NULL")


def aws_pairs(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """``(raw, path, token)``: each access key with the secret key found beside it.

    A key found in several files is paired in the first file, by name, that has
    a pair.
    """
    keys = reportable(findings).filter(provider_of(F.col("rule_id")) == AWS)
    keys = keys.select("raw", F.col("file").alias("path")).distinct()
    paired = keys.join(pair_secret_keys(texts), "path")
    first = F.min_by(F.struct("path", "token"), "path").alias("pair")
    return paired.groupBy("raw").agg(first).select("raw", "pair.path", "pair.token")
