"""One regular expression that finds any of many keywords.

An alternation of forty literals makes java.util.regex try every literal at
every character.  Here each keyword is looked up from its rarest character, so
ordinary prose fails on a single character-class test (measured about three
times faster than a prefix tree of the same words).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysieve.functions.regex import _char, _class_text

# Characters from rare to common in text; anything not listed counts as rare.
BY_RARITY = "zxq_-:/.0123456789jkvbypgwfmculdhrsinoate "
# Characters outside ASCII whose lower case is an ASCII letter.
ODD_CASES = {"i": "\u0130", "k": "\u212a"}


def rarest(chars: Iterable[str]) -> str | None:
    return min(chars, key=BY_RARITY.find, default=None)


def minimal(keywords: Iterable[str]) -> list[str]:
    """Lower-cased keywords without those that contain another one."""
    found = sorted({k.lower() for k in keywords if k})
    return [k for k in found if not any(o != k and o in k for o in found)]


def _cases(char: str) -> list[str]:
    """The characters that lower-case to this one."""
    found = {char}
    if len(char.upper()) == 1 and char.upper().lower() == char:
        found.add(char.upper())
    return sorted(found | set(ODD_CASES.get(char, "")))


def _literal(text: str) -> str:
    # U+0130 lower-cases to an i with a combining dot
    return "".join(_char(ord(c)) + ("\u0307?" if c == "i" else "") for c in text)


def any_pattern(keywords: Iterable[str]) -> str:
    """Finds any keyword in lower-cased text (and, rarely, a near miss)."""
    pivots: dict[str, list[str]] = {}
    for word in minimal(keywords):
        at = min(range(len(word)), key=lambda i: BY_RARITY.find(word[i]))
        behind = f"(?<={_literal(word[:at])}{_char(ord(word[at]))})" if at else ""
        pivots.setdefault(word[at], []).append(behind + _literal(word[at + 1 :]))
    if not pivots:
        return "[^\\s\\S]"
    first = _class_text([(ord(p), ord(p)) for p in pivots])
    branches = "|".join(
        f"{_char(ord(p))}(?:{'|'.join(rest)})" for p, rest in pivots.items()
    )
    return f"(?={first})(?:{branches})"


def holds_any(text: Column, keywords: Iterable[str]) -> Column:
    """True when the lower-cased text contains at least one keyword.

    It may also pass text that only nearly does; :func:`folded` decides.
    """
    return F.lower(text).rlike(any_pattern(keywords))


def folded(text: Column, keywords: Iterable[str]) -> Column:
    """The text with every letter the keywords use in lower case.

    Text of ASCII alone is lower-cased as a whole, which is quicker; letters that no keyword uses do not matter.
    """
    pairs = [(c, char) for char in sorted(set("".join(keywords))) for c in _cases(char) if c != char]
    each = F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(each)
