"""Detection with rules that stay a table, however many there are.

In :mod:`keysieve.operators.detect` rules are constants of the plan, which is
fastest for the dozens of rules of a scan and impossible for tens of thousands.
Here a rule is a row. Each keyword is filed under its rarest run of three
characters, and each run lists at which places of keywords of which lengths it
stands: a small table, as many rules share a run and its places. A line looks up
its own runs there, cuts out what could be a keyword, and looks that up as a
whole, an equi-join; so a line meets the rules whose keyword it holds, however many
others share a run. Only then does a line meet the rest of its rule: pattern, entropy
threshold and allowlists are columns.

The size of the plan does not depend on the number of rules. Patterns are
translated in tasks, once per index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.functions.keywords import BY_RARITY, folded, minimal
from keysieve.functions.regex import PYTHON, parse
from keysieve.functions.text import as_characters, shannon_entropy
from keysieve.operators.detect import _hits, _marked, _marking, allowlisted, any_of, lines_of, records
from keysieve.operators.suppress import DIRECTIVE, REPO, first_directive
from keysieve.sources.rulesets import Allowlist, Rule, RuleError
from keysieve.sources.scratch import materialized
from keysieve.sources.tables import spread

RUN = 3
COMPILED = (
    "rule_ord int, rule_id string, rule_entropy double, rule_heuristic boolean, rule_values string, rule_paths string,"
    " _scope string, _keywords array<string>, _runs array<string>, _places array<string>, _pattern string, _replacement string, _capture string, _problem string"
)
COMPILED_ARROW = pa.schema(
    [
        ("rule_ord", pa.int32()), ("rule_id", pa.string()), ("rule_entropy", pa.float64()), ("rule_heuristic", pa.bool_()),
        ("rule_values", pa.string()), ("rule_paths", pa.string()), ("_scope", pa.string()), ("_keywords", pa.list_(pa.string())),
        ("_runs", pa.list_(pa.string())), ("_places", pa.list_(pa.string())), ("_pattern", pa.string()), ("_replacement", pa.string()), ("_capture", pa.string()),
        ("_problem", pa.string()),
    ]
)


def rarest_run(keyword: str, size: int = RUN) -> str:
    """The run of characters of a keyword that text is least likely to hold; a shorter keyword is its own run."""
    runs = [keyword[i : i + size] for i in range(max(1, len(keyword) - size + 1))]
    return min(runs, key=lambda run: (sum(BY_RARITY.find(c) for c in run), run))


def place_of(run: str, keyword: str) -> str:
    """A pattern that cuts out every text as long as the keyword with the run at the same place."""
    at = keyword.index(run)
    return f"(?s)(?=(.{{{at}}}\\Q{run}\\E.{{{len(keyword) - at - len(run)}}}))"


def _compiled(row: dict) -> dict:
    """A rule as columns; what cannot be used names its problem instead."""
    words = minimal(row["keywords"] or ())
    lists = [Allowlist(regexes=tuple(a["regexes"] or ()), paths=tuple(a["paths"] or ())) for a in row["allowlists"] or ()]
    out = {
        "rule_ord": row["ordinal"], "rule_id": row["id"], "rule_entropy": row["entropy"] or None,
        "rule_heuristic": True if row["is_heuristic"] else None, "_scope": row.get(REPO) or "", "_keywords": words, "_runs": [rarest_run(w) for w in words],
        "_places": [place_of(rarest_run(w), w) for w in words],
    }
    rule = Rule(id=row["id"], regex=row["regex"], keywords=tuple(words), secret_group=row["secret_group"] or 0)
    try:
        out["rule_values"] = any_of(p for a in lists for p in a.regexes)
        out["rule_paths"] = any_of(p for a in lists for p in a.paths)
        marking = _marking(rule)
        if marking is None:
            out["_capture"] = parse(rule.regex, PYTHON).capture(rule.group)
        else:
            out["_pattern"], out["_replacement"] = marking[0], _marked(marking[1], "$")
    except ValueError as error:  # a PatternError, by whatever way its class came to the task
        out["_problem"] = f"rule {row['id']!r}: invalid pattern: {error}"
    if rule.secret_group < 0:
        out["_problem"] = f"rule {row['id']!r}: negative secret_group"
    return out


def _compile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([_compiled(row) for row in batch.to_pylist()], COMPILED_ARROW)


@F.pandas_udf(T.StringType())
def _cut_by_capture(patterns: pd.Series, subjects: pd.Series) -> pd.Series:
    """Lines cut at every match of rules whose secret sits under a repetition or an alternation."""
    known: dict[str, re.Pattern] = {}

    def marked(pattern: re.Pattern, text: str) -> str:
        out, at, done = [], 0, 0
        while at <= len(text) and (match := pattern.search(text, at)):
            first, last = match.span()
            start, end = match.span(1) if match.start(1) >= 0 else (first, last)
            out.append("\n".join((text[done:first], text[first:start], text[start:end], text[end:last])) + "\n")
            done, at = last, last + (first == last)
        return "".join(out) + text[done:]

    cuts = []
    for pattern, text in zip(patterns, subjects):
        if pattern is None or text is None:
            cuts.append(None)
        else:
            cuts.append(marked(known.setdefault(pattern, re.compile(pattern)), text))
    return pd.Series(cuts, index=patterns.index, dtype=object)


@dataclass(frozen=True)
class RuleIndex:
    """``rules`` has a row per rule, ``words`` a row per keyword: ``run, scope, keyword, earlier, rule_ord``.

    ``runs`` has a row per run, with the ``places`` it has in keywords.
    """

    rules: DataFrame
    words: DataFrame
    runs: DataFrame
    letters: str
    sizes: tuple[int, ...]
    #: Whether there are rules whose secret sits under a repetition or an alternation.
    nested: bool
    #: Whether rules may hold for one repository only; lines then have a ``repo``.
    scoped: bool = False


def build_index(table: DataFrame) -> RuleIndex:
    """The index of a table of rules, as :func:`keysieve.sources.rulesets.rules_table` lays them out.

    Ordinals are unique in the table. With a ``repo`` column, a rule holds for that
    repository alone, one without for all.

    A pattern that cannot be read fails the build and is named. Rules without a
    keyword are never tried. The driver gets the distinct letters of all keywords,
    to fold their cases, and the lengths of runs.
    """
    rules = materialized(spread(table.filter("regex <> ''")).mapInArrow(_compile, COMPILED), "rules")
    problem = rules.filter("_problem IS NOT NULL").orderBy("rule_ord").select("_problem").first()
    if problem:
        raise RuleError(problem["_problem"])
    each = rules.select("rule_ord", "_scope", "_keywords", F.posexplode(F.arrays_zip("_keywords", "_runs", "_places")).alias("_at", "_word"))
    words = each.select(
        F.col("_word._runs").alias("run"), F.col("_scope").alias("scope"), F.col("_word._keywords").alias("keyword"),
        F.slice("_keywords", F.lit(1), F.col("_at")).alias("earlier"), "rule_ord",
    )
    words = materialized(words, "rule-words")
    places = each.groupBy(F.col("_word._runs").alias("run")).agg(F.collect_set("_word._places").alias("places"))
    runs = materialized(places, "rule-runs")
    letters = words.select(F.explode(F.array_distinct(F.split("keyword", ""))).alias("c")).distinct()
    found = sorted(r["c"] for r in letters.collect() if r["c"].isalpha())
    sizes = sorted(r["n"] for r in runs.select(F.char_length("run").alias("n")).distinct().collect())
    nested = not rules.filter("_capture IS NOT NULL").limit(1).isEmpty()
    return RuleIndex(rules.drop("_problem", "_scope", "_keywords", "_runs", "_places"), words, runs, "".join(found), tuple(sizes), nested, REPO in table.columns)


def indexed_candidates(lines: DataFrame, index: RuleIndex, directive: str | None = None) -> DataFrame:
    """One row per line and rule with one of the rule's keywords on the line, with the rule's columns."""
    low = folded(F.col("line"), [index.letters])
    runs = [F.regexp_extract_all("_low", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in index.sizes]
    every = F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<string>")
    broken = F.raise_error(F.lit("a line holds a newline; cut texts with lines_of")).cast("string")
    whole = F.when(F.contains("line", F.lit("\n")), broken).otherwise(F.col("line"))
    each = lines.withColumn("line", whole).withColumn("_low", low).select("*", F.explode(every).alias("run"))
    found = F.transform("places", lambda place: F.regexp_extract_all("_low", place, F.lit(1)))
    each = each.join(index.runs, "run").withColumn("keyword", F.explode(F.array_distinct(F.flatten(found)))).drop("places")
    own = F.array(F.lit(""), F.coalesce(F.col(REPO), F.lit(""))) if index.scoped else F.array(F.lit(""))
    each = each.withColumn("scope", F.explode(F.array_distinct(own)))
    # a keyword is filed under one run, so a line meets it once
    tried = each.join(index.words, ["run", "keyword", "scope"]).filter(
        F.contains("_low", F.col("keyword")) & ~F.exists("earlier", lambda word: F.contains(F.col("_low"), word))
    )
    tried = tried.drop("run", "scope", "keyword", "earlier", "_low")
    if directive is not None:
        tried = tried.withColumn("_directive", first_directive(F.col("line"), directive))
    return tried.join(index.rules, "rule_ord")


def detect_indexed(
    lines: DataFrame,
    index: RuleIndex,
    *,
    allowlists: tuple[Allowlist, ...] = (),
    no_entropy: bool = False,
    directive: str | None = DIRECTIVE,
    keep: tuple[str, ...] = (),
    keep_raw: bool = False,
    honor_rule_paths: bool = False,
) -> DataFrame:
    """The findings of :func:`keysieve.operators.detect.detect` for rules that are a table.

    ``allowlists`` are the global ones. All patterns are matched by the JVM, but
    for those whose secret sits under a repetition or an alternation.
    """
    tried = indexed_candidates(lines, index, directive).select(
        "*", as_characters(F.col("line")).alias("_subject"), (~F.is_valid_utf8("line")).alias("_latin")
    )
    cut = F.regexp_replace("_subject", F.col("_pattern"), F.col("_replacement"))
    if index.nested:
        under = F.col("_pattern").isNull()
        by_capture = _cut_by_capture(F.when(under, F.col("_capture")), F.when(under, F.col("_subject")))
        tried = tried.withColumn("_by_capture", by_capture)
        cut = F.when(under, F.col("_by_capture")).otherwise(cut)
    found = _hits(tried.withColumn("_pieces", F.split(cut, "\n")), F.col("rule_id"))
    if not no_entropy:
        least = F.col("rule_entropy")
        found = found.filter(~(least > 0) | least.isNull() | (shannon_entropy(F.col("value"), F.octet_length("raw")) > least))
    own: Column = F.coalesce(F.rlike(F.col("value"), F.col("rule_values")), F.lit(False))
    if honor_rule_paths:
        own = own | F.coalesce(F.rlike(F.col("path"), F.col("rule_paths")), F.lit(False))
    found = found.filter(~allowlisted(F.col("value"), F.col("path"), allowlists) & ~own)
    return records(found, F.col("rule_heuristic"), directive=directive, keep=keep, keep_raw=keep_raw)


def detect_texts_indexed(texts: DataFrame, index: RuleIndex, **options) -> DataFrame:
    """Findings of whole texts ``(path, text, ...)``."""
    return detect_indexed(lines_of(texts), index, **options)
