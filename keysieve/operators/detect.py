"""Detection: lines in, redacted findings out, as one narrow pass.

    gate -> candidates -> matches -> screened -> findings

Each step is a DataFrame to DataFrame function made of built-in expressions;
none shuffles, so the same code runs on a batch table and on a stream.  Rules
are constants of the plan.  The only Python in it is an Arrow function for
rules whose secret sits under a repetition or an alternation, and for rules that
are to be matched in linear time; it is in the plan only if such a rule is, and
sees the lines of such rules only.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.functions.arrays import running_starts
from keysieve.functions.keywords import folded, holds_any, minimal, rarest
from keysieve.functions.regex import JAVA, PYTHON, RE2, parse, portable
from keysieve.functions.text import (
    LATIN,
    as_characters,
    bytes_as_text,
    drop_cr,
    file_lines,
    fingerprint,
    from_characters,
    redact_bytes,
    shannon_entropy,
)
from keysieve.operators.suppress import DIRECTIVE, INLINE, first_directive, in_scope
from keysieve.sources.rulesets import Allowlist, Rule, RuleSet

COMMIT_COLUMNS = ("commit_sha", "commit_author", "commit_date")
FINDING_COLUMNS = (
    "rule_id", "file", "line", "column", "match", "secret", "fingerprint", "is_heuristic",
    "suppressed", "suppression_reason", "commit_sha", "commit_author", "commit_date",
    "verification",
)
#: Up to so many matches on a line, their places are summed one by one; beyond, in one pass over the line.
FEW_HITS = 4
VERIFICATION_TYPE = "struct<status: string, provider: string>"


def quoted(text: str) -> str:
    """The text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def per_rule(ruleset: RuleSet, value, otherwise: str = "NULL") -> Column:
    """``CASE rule_ord WHEN 0 THEN value(rule 0) ...`` over the rules that have a value.

    Values are SQL text: with many rules, parsing one expression is far quicker
    than assembling it call by call.
    """
    branches = [
        f"WHEN {ordinal} THEN {branch}"
        for ordinal, rule in enumerate(ruleset.rules)
        if (branch := value(rule)) is not None
    ]
    return F.expr(f"CASE rule_ord {' '.join(branches)} ELSE {otherwise} END" if branches else otherwise)


def _found_as_soon(pattern: str) -> str:
    """A pattern that finds something in the same texts, without the repetition of any character at its start.

    A search begins at every character, so ``.+x`` would read the rest of the text at
    each of them, and finds something exactly where ``.x`` does.
    """
    if pattern[:2] in (".+", ".*") and pattern[2:3] not in ("+", "*", "?", "{"):
        return _found_as_soon("." + pattern[2:] if pattern[1] == "+" else pattern[2:])
    return pattern


def any_of(patterns) -> str | None:
    """One pattern that finds something in whatever any of the given ones does; what it finds may be shorter."""
    patterns = [_found_as_soon(p) for p in patterns]
    return "|".join(f"(?:{portable(p)})" for p in patterns) if patterns else None


def allowlisted(value: Column, path: Column, allowlists: tuple[Allowlist, ...]) -> Column:
    """True when a value pattern finds something in the secret, or a path pattern in the path."""
    tests = []
    if values := any_of(p for a in allowlists for p in a.regexes):
        tests.append(value.rlike(values))
    if paths := any_of(p for a in allowlists for p in a.paths):
        tests.append(path.rlike(paths))
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def path_allowlisted(path: Column, ruleset: RuleSet) -> Column:
    paths = tuple(Allowlist(paths=a.paths) for a in ruleset.allowlists)
    return allowlisted(F.lit(""), path, paths)


def gate(lines: DataFrame, ruleset: RuleSet, column: str = "line") -> DataFrame:
    """Keep rows whose text holds any keyword of any rule."""
    return lines.filter(holds_any(F.col(column), ruleset.keywords))


def candidates(lines: DataFrame, ruleset: RuleSet, directive: str | None = None) -> DataFrame:
    """One row per line and rule with one of the rule's keywords on the line.

    With a ``directive``, ``_directive`` is the first one on the line, found once
    per line. A line must not hold a newline.
    """
    words = [minimal(rule.keywords) for rule in ruleset.rules]
    tried = ", ".join(
        f"CASE WHEN {' OR '.join(f'contains(_low, {quoted(w)})' for w in group)} THEN {ordinal} END"
        for ordinal, group in enumerate(words)
        if group
    )
    low = folded(F.col("line"), [w for group in words for w in group])
    broken = F.raise_error(F.lit("a line holds a newline; cut texts with lines_of")).cast("string")
    worth = gate(lines, ruleset)
    worth = worth.withColumn("line", F.when(F.contains("line", F.lit("\n")), broken).otherwise(F.col("line")))
    if directive is not None:
        worth = worth.withColumn("_directive", first_directive(F.col("line"), directive))
    each = worth.withColumn("_low", low).select(
        "*", F.expr(f"explode(cast(array({tried}) AS array<int>))").alias("rule_ord")
    )
    return each.filter(F.col("rule_ord").isNotNull()).drop("_low")


def _marking(rule: Rule, dialect: str = JAVA) -> tuple[str, list[str]] | None:
    """A pattern with captures, and which of them are before, secret, after.

    None if a match is not simply these three in a row.
    """
    cut = parse(rule.regex, dialect).split(rule.group)
    if cut is None:
        return None
    if cut.bare:
        return f"{cut.before}({cut.secret}){cut.after}", ["", "1", ""]
    return f"({cut.before})({cut.secret})({cut.after})", ["1", "2", "3"]


def _marked(parts: list[str], sign: str) -> str:
    return "\n" + "".join((sign + part if part else "") + "\n" for part in parts)


def _pieces(rule: Rule) -> str | None:
    """SQL for the line cut at every match: gap, before, secret, after, gap, ...

    A line holds no newline, so newlines can mark the cuts: one regular
    expression pass yields all matches with their positions.
    """
    marking = _marking(rule)
    if marking is None:
        return None
    pattern, parts = marking
    replaced = f"regexp_replace(_subject, {quoted(pattern)}, {quoted(_marked(parts, '$'))})"
    needed = rarest(parse(rule.regex).required())
    if needed is None or any(needed in word for word in rule.keywords):
        return replaced
    return f"IF(contains(_subject, {quoted(needed)}), {replaced}, _subject)"


def _nested(specs: dict[int, str]):
    """Arrow function doing the same for rules that cannot be cut on the plan."""

    @F.pandas_udf("string")
    def cut(ordinals: pd.Series, subjects: pd.Series) -> pd.Series:
        compiled = {ordinal: re.compile(text) for ordinal, text in specs.items()}

        def marked(pattern, text):
            out, at, done = [], 0, 0
            while at <= len(text) and (match := pattern.search(text, at)):
                start, end = match.span(1) if match.start(1) >= 0 else match.span()
                first, last = match.span()
                pieces = (text[done:first], text[first:start], text[start:end], text[end:last])
                out.append("\n".join(pieces) + "\n")
                done, at = last, last + (first == last)
            return "".join(out) + text[done:]

        cuts = [
            marked(compiled[o], text) if o in compiled else None
            for o, text in zip(ordinals, subjects)
        ]
        return pd.Series(cuts, index=ordinals.index, dtype=object)

    return cut


def _linear(ruleset: RuleSet) -> dict[int, tuple[str, str]]:
    """Pattern and replacement in RE2 of the rules that the rule set wants matched by it."""
    specs = {}
    for ordinal, rule in enumerate(ruleset.rules):
        if rule.id in ruleset.linear_rules and (marking := _marking(rule, RE2)):
            specs[ordinal] = marking[0], _marked(marking[1], "\\")
    return specs


def _cut_by_re2(specs: dict[int, tuple[str, str]]):
    """Arrow function that cuts lines with RE2 itself, in time linear in their length."""

    @F.pandas_udf("string")
    def cut(ordinals: pd.Series, subjects: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(subjects), index=subjects.index, dtype=object)
        for ordinal, rows in subjects.dropna().groupby(ordinals):
            if ordinal in specs:
                pattern, marked = specs[ordinal]
                lines = pa.array(rows.tolist(), pa.large_string())
                cuts = pc.replace_substring_regex(lines, pattern=pattern, replacement=marked)
                out.loc[rows.index] = cuts.to_pylist()
        return out

    return cut


def matches(lines: DataFrame, ruleset: RuleSet, directive: str | None = None) -> DataFrame:
    """Every match of every candidate rule, with the secret picked out.

    Adds ``rule_ord``, ``rule_id``, ``column`` (1-based byte offset of the
    secret), ``value`` (the secret as text), and ``before``, ``raw``, ``after``
    (the match around the secret, as bytes); ``line`` itself is not carried on,
    so a line with very many matches costs as much as they are long together.

    java.util.regex may take time quadratic in the length of a line, when a
    rule starts often and runs far before it fails. The rule set's
    ``linear_rules`` are matched by RE2 in an Arrow function instead.
    """
    linear = _linear(ruleset)
    nested = {
        ordinal: parse(rule.regex, PYTHON).capture(rule.group)
        for ordinal, rule in enumerate(ruleset.rules)
        if ordinal not in linear and _pieces(rule) is None
    }
    # offsets and hashes refer to the bytes of the line, valid or not
    found = candidates(lines, ruleset, directive).select(
        "*", as_characters(F.col("line")).alias("_subject"), (~F.is_valid_utf8("line")).alias("_latin")
    )
    # Inside a lambda the patterns stay out of the generated Java code, which
    # they would push beyond the method size that the JIT compiles.
    marked = F.transform(F.array("_subject"), lambda s: per_rule(ruleset, _pieces))[0]
    for name, specs, cut in (("_nested", nested, _nested), ("_linear", linear, _cut_by_re2)):
        if specs:
            chosen = F.col("rule_ord").isin(*specs)
            found = found.withColumn(name, cut(specs)("rule_ord", F.when(chosen, F.col("_subject"))))
            marked = F.when(chosen, F.col(name)).otherwise(marked)
    found = found.withColumn("_pieces", F.split(marked, "\n"))
    return _hits(found, per_rule(ruleset, lambda r: quoted(r.id), "cast(NULL AS string)"))


def _hits(found: DataFrame, rule_id: Column) -> DataFrame:
    """One row per match of lines that are cut into ``_pieces``, as :func:`matches` describes it."""
    sizes = F.transform(
        "_pieces",
        lambda p: F.when(F.col("_latin"), F.length(p)).otherwise(F.octet_length(p)).cast("long"),
    )
    found = found.withColumn("_sizes", sizes)
    count = F.floor(F.size("_pieces") / 4).cast("int")
    hits = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    found = found.withColumn("_starts", F.when(count > FEW_HITS, running_starts("_sizes")))

    def piece(hit: Column, at: int) -> Column:
        return F.get("_pieces", hit * 4 + at)

    def start(hit: Column) -> Column:
        sizes = F.slice("_sizes", F.lit(1), hit * 4 + 2)
        few = F.aggregate(sizes, F.lit(0).cast("long"), lambda total, size: total + size)
        return F.coalesce(F.get("_starts", hit * 4 + 2), few)

    each = F.transform(
        hits,
        lambda hit: F.struct(
            (start(hit) + 1).cast("int").alias("column"),
            piece(hit, 1).alias("before"), piece(hit, 2).alias("secret"), piece(hit, 3).alias("after"),
        ),
    )
    kept = [c for c in found.columns if c != "line" and (not c.startswith("_") or c == "_directive")]
    found = found.select(*kept, "_latin", F.explode(each).alias("_hit")).filter(F.col("_hit.secret") != "")

    def raw(text: Column) -> Column:
        return F.when(F.col("_latin"), F.encode(text, LATIN)).otherwise(text.cast("binary"))

    found = found.withColumns(
        {
            "rule_id": rule_id,
            "column": F.col("_hit.column"),
            "before": raw(F.col("_hit.before")),
            "raw": raw(F.col("_hit.secret")),
            "after": raw(F.col("_hit.after")),
        }
    )
    # a secret may be UTF-8 although its line is not
    text = F.coalesce(F.try_validate_utf8(F.col("raw").cast("string")), F.col("_hit.secret"))
    return found.withColumn("value", text).drop("_hit", "_latin")


def entropy_gate(found: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Drop secrets whose entropy does not exceed their rule's threshold."""
    if ruleset.no_entropy:
        return found

    threshold = per_rule(
        ruleset, lambda r: f"{r.entropy!r}D" if r.entropy > 0 else None, "cast(NULL AS double)"
    )
    return found.filter(threshold.isNull() | (shannon_entropy(F.col("value"), F.octet_length("raw")) > threshold))


def allowlist_filter(
    found: DataFrame, ruleset: RuleSet, *, honor_rule_paths: bool = False
) -> DataFrame:
    """Drop allowed values and paths: the global lists first, then the rule's own.

    A rule's own path patterns are ignored unless ``honor_rule_paths`` is set.
    """

    def own(rule: Rule) -> str | None:
        tests = []
        if values := any_of(p for a in rule.allowlists for p in a.regexes):
            tests.append(f"value rlike {quoted(values)}")
        paths = any_of(p for a in rule.allowlists for p in a.paths)
        if paths and honor_rule_paths:
            tests.append(f"path rlike {quoted(paths)}")
        return " OR ".join(tests) or None

    allowed = allowlisted(F.col("value"), F.col("path"), ruleset.allowlists)
    return found.filter(~allowed & ~per_rule(ruleset, own, "false"))


def screened(found: DataFrame, ruleset: RuleSet, *, honor_rule_paths: bool = False) -> DataFrame:
    """The matches that count as findings."""
    found = entropy_gate(found, ruleset)
    return allowlist_filter(found, ruleset, honor_rule_paths=honor_rule_paths)


def project(
    found: DataFrame,
    ruleset: RuleSet,
    *,
    directive: str | None = DIRECTIVE,
    keep: tuple[str, ...] = (),
    keep_raw: bool = False,
) -> DataFrame:
    """Matches to finding records; the raw secret stops here unless asked for.

    A ``directive`` must have been given to :func:`matches` as well.
    """
    heuristic = per_rule(
        ruleset, lambda r: "true" if r.is_heuristic else None, "cast(NULL AS boolean)"
    )
    return records(found, heuristic, directive=directive, keep=keep, keep_raw=keep_raw)


def records(
    found: DataFrame, heuristic: Column, *, directive: str | None, keep: tuple[str, ...], keep_raw: bool
) -> DataFrame:
    """Finding records of matches; ``heuristic`` is true for rules that are, else null."""
    hidden = F.lit(None).cast("boolean")
    if directive is not None:
        hidden = F.when(in_scope(F.col("_directive"), F.col("rule_id"), directive), F.lit(True))
    shown = redact_bytes(F.col("raw"))
    columns = {
        "rule_id": F.col("rule_id"),
        "file": F.col("path"),
        "line": F.col("line_no").cast("int"),
        "column": F.col("column"),
        "match": bytes_as_text(F.concat(F.col("before"), shown, F.col("after"))),
        "secret": bytes_as_text(shown),
        "fingerprint": fingerprint(F.col("path"), F.col("rule_id"), F.col("raw")),
        "is_heuristic": heuristic,
        "suppressed": hidden,
        "suppression_reason": F.when(hidden, F.lit(INLINE)).cast("string"),
        "verification": F.lit(None).cast(VERIFICATION_TYPE),
    }
    for name in COMMIT_COLUMNS:
        given = F.col(name) if name in found.columns else F.lit(None).cast("string")
        columns[name] = given
    picked = [columns[name].alias(name) for name in FINDING_COLUMNS]
    picked += [F.col(name) for name in keep]
    if keep_raw:
        picked.append(F.col("raw"))
    return found.select(*picked)


def detect(
    lines: DataFrame,
    ruleset: RuleSet,
    *,
    directive: str | None = DIRECTIVE,
    keep: tuple[str, ...] = (),
    keep_raw: bool = False,
    honor_rule_paths: bool = False,
) -> DataFrame:
    """Findings of a table of lines ``(path, line_no, line, ...)``.

    Lines under a directive are marked suppressed, not dropped. Commit columns
    and the columns named in ``keep`` are carried through. A line that holds a
    newline is an error.
    """
    found = screened(matches(lines, ruleset, directive), ruleset, honor_rule_paths=honor_rule_paths)
    return project(found, ruleset, directive=directive, keep=keep, keep_raw=keep_raw)


def lines_of(texts: DataFrame) -> DataFrame:
    """``(path, text, ...)`` to one row per line, numbered from 1."""
    kept = [c for c in texts.columns if c != "text"]
    viewed = texts.select(
        *kept,
        (~F.is_valid_utf8("text")).alias("_latin"),
        as_characters(F.col("text")).alias("_text"),
    )
    parts = viewed.select(
        *kept, "_latin", F.posexplode(file_lines(F.col("_text"))).alias("_at", "_line")
    )
    line = from_characters(drop_cr(F.col("_line")), F.col("_latin"))
    return parts.select(*kept, (F.col("_at") + 1).alias("line_no"), line.alias("line"))


def detect_texts(texts: DataFrame, ruleset: RuleSet, **options) -> DataFrame:
    """Findings of whole texts ``(path, text, ...)``.

    Texts without any keyword, or on an allowed path, are dropped before they
    are cut into lines.
    """
    worth = gate(texts.filter(~path_allowlisted(F.col("path"), ruleset)), ruleset, "text")
    return detect(lines_of(worth), ruleset, **options)
