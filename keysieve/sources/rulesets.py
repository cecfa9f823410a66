"""Rules as data: TOML files, merging, validation, and rules held in a table."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, replace
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from keysieve.functions.regex import PatternError, parse

PROJECT_FILE = ".keysieve.toml"
#: No limit; a rule file or a caller may set one.
MAX_FILE_SIZE_MB = 0

ALLOWLIST_TYPE = "struct<description: string, regexes: array<string>, paths: array<string>>"
RULE_SCHEMA = (
    "ordinal int, id string, description string, regex string, entropy double,"
    " keywords array<string>, secret_group int, is_heuristic boolean,"
    f" allowlists array<{ALLOWLIST_TYPE}>"
)


class RuleError(ValueError):
    """A rule or allowlist cannot be used; the message names it."""


@dataclass(frozen=True)
class Allowlist:
    description: str = ""
    regexes: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    regex: str
    keywords: tuple[str, ...] = ()
    description: str = ""
    entropy: float = 0.0
    secret_group: int = 0
    is_heuristic: bool = False
    allowlists: tuple[Allowlist, ...] = ()

    @property
    def group(self) -> int:
        """The capture holding the secret; 0 means the first one."""
        return self.secret_group or 1


@dataclass(frozen=True)
class RuleSet:
    """Rules, global allowlists, and the settings of a scan.

    ``linear_rules`` names the rules to match in time linear in a line's length.
    """

    rules: tuple[Rule, ...]
    allowlists: tuple[Allowlist, ...] = ()
    use_default_excludes: bool = True
    max_file_size_mb: int = MAX_FILE_SIZE_MB
    no_entropy: bool = False
    linear_rules: frozenset[str] = frozenset()
    title: str = ""
    disabled_rules: tuple[str, ...] = field(default=(), compare=False)
    extends_default: bool = field(default=False, compare=False)

    def with_options(self, **changes) -> RuleSet:
        return replace(self, **changes)

    @property
    def keywords(self) -> list[str]:
        return [k for rule in self.rules for k in rule.keywords]

    def only(self, *ids: str) -> RuleSet:
        return replace(self, rules=tuple(r for r in self.rules if r.id in ids))


def _allowlist(raw: dict) -> Allowlist:
    return Allowlist(
        raw.get("description", ""), tuple(raw.get("regexes", ())), tuple(raw.get("paths", ()))
    )


def _rule(raw: dict) -> Rule:
    return Rule(
        id=raw.get("id", ""),
        regex=raw.get("regex", ""),
        keywords=tuple(raw.get("keywords", ())),
        description=raw.get("description", ""),
        entropy=float(raw.get("entropy", 0.0)),
        secret_group=int(raw.get("secret_group", 0)),
        is_heuristic=bool(raw.get("is_heuristic", False)),
        allowlists=tuple(_allowlist(a) for a in raw.get("allowlists", ())),
    )


def read_toml(text: str) -> RuleSet:
    """The rule file exactly as written: nothing merged, nothing validated."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise RuleError(f"rule file does not parse: {error}") from error
    extend = raw.get("extend", {})
    toggle = extend.get("use_default_allowlists")
    return RuleSet(
        rules=tuple(_rule(r) for r in raw.get("rules", ())),
        allowlists=tuple(_allowlist(a) for a in raw.get("allowlists", ())),
        use_default_excludes=toggle is None or bool(toggle),
        title=raw.get("title", ""),
        disabled_rules=tuple(extend.get("disabled_rules", ())),
        extends_default=bool(extend.get("use_default", False)),
    )


def merge_rules(base: RuleSet, overlay: RuleSet) -> RuleSet:
    """Overlay rules replace those of the same id in place, new ones go last;
    then disabled ids are removed. Allowlists add up."""
    merged = {}
    for position, rule in enumerate(base.rules):
        merged[(position, rule.id)] = rule
    places = {rule_id: (position, rule_id) for position, rule_id in merged}
    for position, rule in enumerate(overlay.rules, start=len(base.rules)):
        place = places.setdefault(rule.id, (position, rule.id))
        merged[place] = rule
    kept = tuple(r for r in merged.values() if r.id not in overlay.disabled_rules)
    return replace(overlay, title=base.title, rules=kept, allowlists=base.allowlists + overlay.allowlists)


def validate(ruleset: RuleSet) -> RuleSet:
    """Every pattern must be readable, or the load fails naming its rule."""

    def check(pattern: str, where: str) -> None:
        try:
            parse(pattern)
        except PatternError as error:
            raise RuleError(
                f"{where}: invalid pattern {pattern!r}: {error}"
                " (no lookaround or backreferences; use entropy and allowlists)"
            ) from error

    for allowlist in ruleset.allowlists:
        for pattern in allowlist.regexes:
            check(pattern, "global allowlist")
        for pattern in allowlist.paths:
            check(pattern, "global allowlist path")
    for rule in ruleset.rules:
        check(rule.regex, f"rule {rule.id!r}")
        if rule.secret_group < 0:
            raise RuleError(f"rule {rule.id!r}: negative secret_group")
        for allowlist in rule.allowlists:
            for pattern in allowlist.regexes:
                check(pattern, f"rule {rule.id!r} allowlist")
    return ruleset


def default_rules() -> RuleSet:
    text = resources.files("keysieve").joinpath("rules/default.toml").read_text("utf-8")
    return validate(read_toml(text))


def rules_from_text(text: str) -> RuleSet:
    """A user's rule file, on top of the built-in rules if it asks for them."""
    own = read_toml(text)
    if own.extends_default:
        own = merge_rules(default_rules(), own)
    return validate(own)


def load_rules(path: str | None = None, *, root: str | None = None) -> RuleSet:
    """An explicit file, else the project file under ``root``, else the built-in rules."""
    if path is None and root is not None:
        candidate = os.path.join(root, PROJECT_FILE)
        path = candidate if os.path.exists(candidate) else None
    if path is None:
        return default_rules()
    with open(path, encoding="utf-8") as handle:
        return rules_from_text(handle.read())


def rules_table(spark: SparkSession, ruleset: RuleSet) -> DataFrame:
    """The rules as rows, one per rule, in evaluation order."""
    rows = [
        (
            ordinal, rule.id, rule.description, rule.regex, rule.entropy, list(rule.keywords),
            rule.secret_group, rule.is_heuristic,
            [(a.description, list(a.regexes), list(a.paths)) for a in rule.allowlists],
        )
        for ordinal, rule in enumerate(ruleset.rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_table(table: DataFrame, *, limit: int = 10_000, **options) -> RuleSet:
    """Rules kept in a table. They become plan constants, so a table with more
    than ``limit`` rows is refused rather than read."""
    rows = table.orderBy("ordinal").limit(limit + 1).collect()
    if len(rows) > limit:
        raise RuleError(f"more than {limit} rules")
    rules = tuple(
        _rule({k: v for k, v in row.asDict(recursive=True).items() if v is not None})
        for row in rows
    )
    return validate(RuleSet(rules=rules, **options))
