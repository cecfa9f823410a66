"""Path globs as column predicates.

``*`` and ``?`` stay inside a path segment, ``**`` as a whole segment spans any
number of them, the whole path has to match. Patterns apply in order and the
last one that matches wins, so ``!pattern`` re-includes.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysieve.functions.regex import _char

# Vendored, generated and lock files left out unless asked for.
DEFAULT_EXCLUDES = (
    "**/vendor/**", "vendor/**",
    "**/node_modules/**", "node_modules/**",
    "**/dist/**", "**/build/**",
    "**/*.min.js", "**/*.min.css", "**/*.map",
    "**/package-lock.json", "**/npm-shrinkwrap.json",
    "**/yarn.lock", "**/pnpm-lock.yaml",
    "**/go.sum",
    "**/Gemfile.lock", "**/poetry.lock", "**/Pipfile.lock",
    "**/composer.lock", "**/Cargo.lock",
)


#: What ``/**`` at the end of a glob becomes, and ``*``.
SUBTREE, WITHIN = "(?:/[\\s\\S]*)?", "[^/]*"


class GlobError(ValueError):
    """The pattern is malformed."""


def _segment_class(glob: str, at: int) -> tuple[str, int]:
    """``[a-z]`` or ``[!a-z]``; never a path separator."""
    negate = glob[at : at + 1] in ("^", "!")
    at += negate
    body, first = "", True
    while glob[at : at + 1] != "]" or first:
        first = False
        char = glob[at : at + 1]
        if char == "\\":
            at += 1
            char = glob[at : at + 1]
        if not char:
            raise GlobError(f"unclosed class in {glob!r}")
        ranged = char == "-" and body and glob[at + 1 : at + 2] not in ("]", "")
        body += "-" if ranged else _char(ord(char))
        at += 1
    return f"(?!/)[{'^' if negate else ''}{body}]", at + 1


def glob_pattern(glob: str) -> str:
    """The glob as an anchored regular expression."""
    return f"\\A(?:{_body(glob)})\\z"


def any_glob(globs: Iterable[str]) -> str:
    """A regular expression that finds something in the paths that any of the globs matches.

    The same as their patterns side by side, for less: a path is read once and not
    once for each glob with ``**``. A glob that begins with ``**/`` is tried where a
    segment begins, or anywhere if ``*`` follows; below a subtree nothing is read.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for glob in dict.fromkeys(globs):
        anywhere = glob.startswith("**/")
        body = _body(glob[3:] if anywhere else glob)
        before, after = "(?:\\A|/)" if anywhere else "\\A", "\\z"
        if body.endswith(SUBTREE):
            body, after = body.removesuffix(SUBTREE), "(?:/|\\z)"
        if anywhere and body.startswith(WITHIN):
            body, before = body.removeprefix(WITHIN), ""
        groups.setdefault((before, after), []).append(body)
    return "|".join(f"{before}(?:{'|'.join(bodies)}){after}" for (before, after), bodies in groups.items())


def _body(glob: str) -> str:
    """The glob as a regular expression without its anchors."""

    def read(at: int, depth: int, start: bool) -> tuple[str, int]:
        out = ""
        while at < len(glob):
            char = glob[at]
            if char == "*" and glob.startswith("**", at) and start:
                after = glob[at + 2 : at + 3]
                if after == "/":
                    out, at = out + "(?:[\\s\\S]*/)?", at + 3
                    continue
                if after == "" or (depth and after in ",}"):
                    out, at, start = out + "[\\s\\S]*", at + 2, False
                    continue
            if char == "*":
                at += 2 if glob.startswith("**", at) else 1
                out, start = out + WITHIN, False
                continue
            if char == "/" and glob[at:] in ("/**", "/**/"):
                # "a/**" is also a itself, which might be a directory
                return out + (SUBTREE if glob[at:] == "/**" else "(?:/(?:[\\s\\S]*/)?)?"), len(glob)
            if char == "?":
                out, at = out + "[^/]", at + 1
            elif char == "[":
                text, at = _segment_class(glob, at + 1)
                out += text
            elif char == "{":
                options, at = [], at + 1
                while True:
                    text, at = read(at, depth + 1, start)
                    options.append(text)
                    if at >= len(glob):
                        raise GlobError(f"unclosed braces in {glob!r}")
                    at += 1
                    if glob[at - 1] == "}":
                        break
                out += f"(?:{'|'.join(options)})"
            elif depth and char in ",}":
                return out, at
            elif char == "}":
                raise GlobError(f"unopened brace in {glob!r}")
            else:
                if char == "\\":
                    at += 1
                    if at >= len(glob):
                        raise GlobError(f"trailing backslash in {glob!r}")
                    char = glob[at]
                out, at = out + _char(ord(char)), at + 1
            start = char == "/"
        if depth:
            raise GlobError(f"unclosed braces in {glob!r}")
        return out, at

    return read(0, 0, True)[0]


def ignore_lines(text: str) -> list[str]:
    """The patterns of an ignore file: trimmed, without blanks and comments."""
    stripped = (line.strip() for line in text.splitlines())
    return [line for line in stripped if line and not line.startswith("#")]


@dataclass(frozen=True)
class PathMatcher:
    """Ordered (glob, negated) patterns, as predicates on a path column."""

    patterns: tuple[tuple[str, bool], ...]

    def _last_match(self, path: Column, directory: bool) -> Column:
        runs: list[tuple[bool, list[str]]] = []
        for glob, negated in self.patterns:
            globs = [glob]
            if directory and glob.endswith("/**"):
                globs.append(glob[: -len("/**")])
            if runs and runs[-1][0] == negated:
                runs[-1][1].extend(globs)
            else:
                runs.append((negated, globs))
        verdict = None
        for negated, globs in reversed(runs):
            test = path.rlike(any_glob(globs))
            answer = F.lit(not negated)
            verdict = F.when(test, answer) if verdict is None else verdict.when(test, answer)
        named = ~path.isin("", ".")
        return F.lit(False) if verdict is None else named & verdict.otherwise(F.lit(False))

    def file_excluded(self, path: Column) -> Column:
        """The file itself is excluded, whatever its directories are."""
        return self._last_match(normal_path(path), False)

    def directory_excluded(self, path: Column) -> Column:
        return self._last_match(normal_path(path), True)

    def excluded_by(self, path: Column) -> Column:
        """The topmost excluded directory above the file, else the file if it is
        excluded, else null. An excluded directory hides its whole subtree, so
        a pattern cannot re-include a file below it."""
        parts = F.split(normal_path(path), "/")
        above = F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1),
            lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"),
        )
        pruned = F.filter(above, lambda folder: self._last_match(folder, True))
        return F.coalesce(
            F.get(pruned, 0), F.when(self.file_excluded(path), normal_path(path))
        )

    def __call__(self, path: Column) -> Column:
        return self.excluded_by(path).isNotNull()


def normal_path(path: Column) -> Column:
    slashed = F.translate(path, "\\", "/")
    return F.when(F.startswith(slashed, F.lit("./")), F.substr(slashed, F.lit(3))).otherwise(slashed)


def parse_pattern(line: str) -> tuple[str, bool]:
    """A line of an ignore file as a glob and whether it takes back earlier ones."""
    negated = line.startswith("!")
    return line[negated:].strip(), negated


def path_matcher(lines: Iterable[str] = (), defaults: bool = True) -> PathMatcher:
    """Default globs, then the given ignore lines; a malformed line is an error."""
    own = [parse_pattern(line) for line in ignore_lines("\n".join(lines))]
    patterns = [(glob, negated) for glob, negated in own if glob]
    for glob, _ in patterns:
        glob_pattern(glob)
    return PathMatcher((*((glob, False) for glob in DEFAULT_EXCLUDES if defaults), *patterns))
