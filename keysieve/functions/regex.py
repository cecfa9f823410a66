"""RE2-dialect patterns made portable.

Rules are written in RE2 syntax (ASCII ``\\b`` and ``\\w``, ``$`` only at the end
of the text, Unicode case folding, no lookaround).  Spark evaluates patterns
with java.util.regex, which differs on every one of those points, so a rule is
read once on the driver and written out again in the subset on which Java and
Python agree: explicit character classes, no inline flags, ``\\A``/``\\z``
anchors.  Nothing here touches data.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

MAX_CODE = 0x10FFFF
MAX_REPEAT = 1000
BIT_CLASS = 256

# The class members RE2 defines for its escapes and POSIX names.
DIGIT = ((0x30, 0x39),)
SPACE = ((0x09, 0x0A), (0x0C, 0x0D), (0x20, 0x20))
WORD = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
POSIX = {
    "alnum": ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)),
    "alpha": ((0x41, 0x5A), (0x61, 0x7A)),
    "ascii": ((0x00, 0x7F),),
    "blank": ((0x09, 0x09), (0x20, 0x20)),
    "cntrl": ((0x00, 0x1F), (0x7F, 0x7F)),
    "digit": DIGIT,
    "graph": ((0x21, 0x7E),),
    "lower": ((0x61, 0x7A),),
    "print": ((0x20, 0x7E),),
    "punct": ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "space": ((0x09, 0x0D), (0x20, 0x20)),
    "upper": ((0x41, 0x5A),),
    "word": WORD,
    "xdigit": ((0x30, 0x39), (0x41, 0x46), (0x61, 0x66)),
}
# Code points outside ASCII that fold onto an ASCII letter.
#: Cased characters lie below this; dotted and dotless i have no other case in RE2.
CASED_CODES = 0x1E944
UNFOLDED = {0x0130, 0x0131}

# Where the dialects differ: word edges (ASCII in RE2 only), line and text ends.
_EDGE = "(?:(?<!{w})(?={w})|(?<={w})(?!{w}))"
_NO_EDGE = "(?:(?<!{w})(?!{w})|(?<={w})(?={w}))"
JAVA, PYTHON, RE2 = "java", "python", "re2"
ASSERTIONS = {
    JAVA: {"edge": _EDGE.format(w="\\w"), "inside": _NO_EDGE.format(w="\\w"), "end": "\\z"},
    PYTHON: {
        "edge": _EDGE.format(w="[0-9A-Za-z_]"), "inside": _NO_EDGE.format(w="[0-9A-Za-z_]"), "end": "\\Z",
    },
    RE2: {"edge": "\\b", "inside": "\\B", "end": "\\z"},
}
for _name, _texts in ASSERTIONS.items():
    _texts["line start"] = "(?m:^)" if _name == RE2 else "(?:\\A|(?<=\\n))"
    _texts["line end"] = "(?m:$)" if _name == RE2 else f"(?=\\n|{_texts['end']})"


class remembered:
    """A function that remembers its latest results.

    Unlike what ``functools`` offers, it travels to tasks by value, as the functions
    of this package do, and leaves behind what it remembers.
    """

    MOST = 4096

    def __init__(self, work):
        self.work, self.known = work, {}
        self.__doc__ = work.__doc__

    def __call__(self, *given):
        if given not in self.known:
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[given] = self.work(*given)
        return self.known[given]

    def __reduce__(self):
        return remembered, (self.work,)


class PatternError(ValueError):
    """The pattern is not valid RE2 syntax (or uses a construct RE2 lacks)."""


@dataclass
class Atom:
    """One already rendered unit; ``width`` is the fewest characters it takes."""

    text: str
    width: int = 1
    first: tuple = ()
    low: int = 1
    quant: str = ""

    def render(self) -> str:
        if not self.quant:
            return self.text
        body = self.text if self.width else f"(?:{self.text})"
        return body + self.quant

    def min_width(self) -> int:
        return self.width * self.low


@dataclass
class Group:
    """Parentheses: ``index`` is the capture number, None when not capturing."""

    index: int | None
    branches: list[list] = field(default_factory=list)
    low: int = 1
    quant: str = ""
    width = 1

    def body(self) -> str:
        return "|".join("".join(n.render() for n in b) for b in self.branches)

    def render(self) -> str:
        return f"(?:{self.body()}){self.quant}"

    def min_width(self) -> int:
        return self.low * min(sum(n.min_width() for n in b) for b in self.branches)

    @property
    def first(self) -> tuple:
        """Every character a match of the group can start with."""
        return _merge(span for branch in self.branches for span in _first(branch))

    def holds(self, index: int) -> bool:
        if self.index == index:
            return True
        return any(
            isinstance(n, Group) and n.holds(index) for b in self.branches for n in b
        )


def _first(nodes: list) -> list:
    found = []
    for node in nodes:
        found.extend(node.first)
        if node.min_width():
            return found
    return [(0, MAX_CODE)]  # may start with whatever follows


def _required(group: Group) -> list[str]:
    if len(group.branches) != 1 or not group.low:
        return []
    found = []
    for node in group.branches[0]:
        if isinstance(node, Group):
            found.extend(_required(node))
        elif node.min_width() and len(node.first) == 1 and node.first[0][0] == node.first[0][1]:
            found.append(chr(node.first[0][0]))
    return found


def _disjoint(one, other) -> bool:
    return all(b < c or d < a for a, b in one for c, d in other)


def _settle(group: Group, follow: tuple) -> None:
    """Make repetitions possessive where giving characters back cannot help.

    That is so when nothing that may follow starts with a character of the
    repeated class. RE2 never backtracks; this keeps java.util.regex from
    walking back over long runs.
    """
    for branch in group.branches:
        after = follow
        for node in reversed(branch):
            if isinstance(node, Group):
                _settle(node, _merge((*after, *node.first)) if node.quant else after)
            elif node.quant in ("*", "+", "?") or node.quant.endswith("}"):
                if _disjoint(node.first, after):
                    node.quant += "+"
            after = node.first if node.min_width() else _merge((*node.first, *after))


@dataclass(frozen=True)
class Split:
    """A rule cut around its secret: ``before`` + ``secret`` + ``after``.

    ``bare`` means that before and after only assert and take no characters.
    """

    before: str
    secret: str
    after: str
    bare: bool


@dataclass
class Pattern:
    root: Group
    groups: int
    dialect: str

    @property
    def text(self) -> str:
        """The whole pattern, without any capture."""
        return self.root.body()

    def required(self) -> list[str]:
        """Characters that every match contains."""
        return _required(self.root)

    def guard(self) -> str:
        """A lookahead for the characters a match can start with.

        It spares java.util.regex trying assertions and every branch of an
        alternation at each character of the line.
        """
        if self.dialect == RE2:
            return ""
        head = next((n for n in self.root.branches[0] if n.width or n.quant), None)
        plain = len(self.root.branches) == 1 and head is self.root.branches[0][0]
        if plain and not (isinstance(head, Group) and len(head.branches) > 1):
            return ""
        first = self.root.first
        return "" if first == ((0, MAX_CODE),) else f"(?={_class_text(first)})"

    def split(self, index: int) -> Split | None:
        """Cut around capture ``index``.

        None when the capture sits under a repetition or an alternation, so
        that the match is not simply before + secret + after.
        """
        if index > self.groups:
            return Split(self.guard(), self.text, "", True)
        parts = _cut(self.root, index)
        if parts is None:
            return None
        before, secret, after = parts
        bare = not any(isinstance(n, Group) or n.width for n in before + after)
        return Split(
            self.guard() + "".join(n.render() for n in before),
            secret,
            "".join(n.render() for n in after),
            bare,
        )

    def capture(self, index: int) -> str:
        """The pattern with only capture ``index`` kept (as group 1)."""
        return _render_capture(self.root, index, outer=True)


def _cut(group: Group, index: int):
    if len(group.branches) != 1:
        return None
    nodes = group.branches[0]
    for at, node in enumerate(nodes):
        if isinstance(node, Group) and node.holds(index):
            if node.quant:
                return None
            if node.index == index:
                return nodes[:at], node.body(), nodes[at + 1 :]
            inner = _cut(node, index)
            if inner is None:
                return None
            return nodes[:at] + inner[0], inner[1], inner[2] + nodes[at + 1 :]
    return None


def _render_capture(group: Group, index: int, outer: bool = False) -> str:
    def one(node) -> str:
        if isinstance(node, Group) and node.holds(index):
            return _render_capture(node, index)
        return node.render()

    body = "|".join("".join(one(n) for n in b) for b in group.branches)
    if outer:
        return body
    opening = "(" if group.index == index else "(?:"
    return f"{opening}{body}){group.quant}"


# --- character classes ------------------------------------------------------


def _merge(ranges) -> tuple:
    merged: list[list[int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return tuple((low, high) for low, high in merged)


def _complement(ranges) -> tuple:
    out, at = [], 0
    for low, high in _merge(ranges):
        if low > at:
            out.append((at, low - 1))
        at = high + 1
    if at <= MAX_CODE:
        out.append((at, MAX_CODE))
    return tuple(out)


@remembered
def _orbits() -> dict[int, frozenset[int]]:
    """For each cased character, all characters that differ from it in case alone.

    Built from the one-to-one mappings of every cased character, in both
    directions: some letters are only reached from the other side. Dotted and
    dotless i fold to themselves.
    """
    group: dict[int, set[int]] = {}
    for code in range(CASED_CODES):
        char = chr(code)
        for other in (char.lower(), char.upper(), char.title()):
            if other != char and len(other) == 1 and not {code, ord(other)} & UNFOLDED:
                joined = group.get(code, {code}) | group.get(ord(other), {ord(other)})
                for member in joined:
                    group[member] = joined
    return {code: frozenset(members) for code, members in group.items()}


def _fold_char(code: int) -> set[int]:
    return set(_orbits().get(code, (code,)))


def _fold(ranges) -> tuple:
    found = list(ranges)
    for low, high in ranges:
        if (low, high) == (0, MAX_CODE):
            return ((0, MAX_CODE),)
        for code in range(low, min(high, 0x1E943) + 1):
            found.extend((c, c) for c in _fold_char(code) if not low <= c <= high)
    return _merge(found)


@remembered
def _category(name: str) -> tuple:
    ranges, start = [], None
    for code in range(MAX_CODE + 2):
        inside = code <= MAX_CODE and unicodedata.category(chr(code)).startswith(name)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            ranges.append((start, code - 1))
            start = None
    return tuple(ranges)


def _char(code: int, dialect: str = JAVA) -> str:
    char = chr(code)
    if char.isascii() and (char.isalnum() or char in " _"):
        return char
    if 0x21 <= code <= 0x7E:
        return "\\" + char
    if dialect == PYTHON:
        return f"\\U{code:08X}"
    return f"\\x{{{code:X}}}"


def _range_text(low: int, high: int, dialect: str) -> str:
    if dialect == JAVA and low < BIT_CLASS:
        # java.util.regex tests listed Latin-1 characters with one table lookup,
        # but every range with a call of its own
        listed = "".join(_char(c) for c in range(low, min(high, BIT_CLASS - 1) + 1))
        return listed + (_range_text(BIT_CLASS, high, dialect) if high >= BIT_CLASS else "")
    ends = [low] if low == high else [low, high]
    return ("-" if high > low + 1 else "").join(_char(c, dialect) for c in ends)


def _class_text(ranges, dialect: str = JAVA) -> str:
    ranges = _merge(ranges)
    if ranges == ((0, MAX_CODE),):
        return "[\\s\\S]"
    if not ranges:
        return "[^\\s\\S]"
    if len(ranges) == 1 and ranges[0][0] == ranges[0][1]:
        return _char(ranges[0][0], dialect)
    sign = ""
    if ranges[0][0] == 0 and ranges[-1][1] == MAX_CODE:
        sign, ranges = "^", _complement(ranges)
    if ranges == WORD and dialect == JAVA:
        return "[^\\w]" if sign else "\\w"
    body = "".join(_range_text(low, high, dialect) for low, high in ranges)
    return f"[{sign}{body}]"


# --- reader -----------------------------------------------------------------


class _Reader:
    def __init__(self, source: str, dialect: str):
        self.source = source
        self.dialect = dialect
        self.assertions = ASSERTIONS[dialect]
        self.at = 0
        self.captures = 0
        self.names: set[str] = set()

    def fail(self, why: str):
        raise PatternError(f"{why} at offset {self.at}")

    def peek(self, text: str) -> bool:
        return self.source.startswith(text, self.at)

    def take(self, text: str) -> bool:
        if self.peek(text):
            self.at += len(text)
            return True
        return False

    def next(self) -> str:
        if self.at >= len(self.source):
            self.fail("pattern ends early")
        self.at += 1
        return self.source[self.at - 1]

    def read(self) -> Pattern:
        root = Group(None, self.branches(frozenset()))
        if self.at < len(self.source):
            self.fail("unmatched )")
        if self.dialect == JAVA:
            _settle(root, ((0, MAX_CODE),))
        return Pattern(root, self.captures, self.dialect)

    def branches(self, flags: frozenset) -> list[list]:
        done, current = [], []
        while self.at < len(self.source) and not self.peek(")"):
            if self.take("|"):
                done.append(current)
                current = []
            elif self.peek("(?") and (changed := self.flag_change(flags)) is not None:
                flags = changed
            else:
                current.extend(self.item(flags))
        return done + [current]

    def flag_change(self, flags: frozenset) -> frozenset | None:
        """Reads ``(?i)`` and the like; leaves any other group untouched."""
        end = self.source.find(")", self.at)
        letters = self.source[self.at + 2 : end] if end > 0 else ""
        if not letters or letters.strip("imsU-"):
            return None
        self.at = end + 1
        return self.apply_flags(flags, letters)

    def apply_flags(self, flags: frozenset, letters: str) -> frozenset:
        on, _, off = letters.partition("-")
        if "-" in off or (letters.endswith("-")):
            self.fail("bad flags")
        return (flags | set(on)) - set(off)

    def item(self, flags: frozenset) -> list:
        nodes = self.atom(flags)
        repeat = self.repeat()
        if repeat is None:
            return nodes
        if not nodes:
            self.fail("nothing to repeat")
        low, text = repeat
        lazy = self.take("?")
        if self.repeat() is not None or self.peek("+"):
            self.fail("repeated repetition operator")
        if lazy != ("U" in flags):
            text += "?"
        last = nodes[-1]
        last.low, last.quant = low, text
        return nodes

    def repeat(self) -> tuple[int, str] | None:
        for sign, low in (("*", 0), ("+", 1), ("?", 0)):
            if self.take(sign):
                return low, sign
        if not self.peek("{"):
            return None
        end = self.source.find("}", self.at)
        low, comma, high = self.source[self.at + 1 : max(end, 0)].partition(",")
        digits = low.isascii() and low.isdigit()
        if end < 0 or not digits or (high and not (high.isascii() and high.isdigit())):
            return None  # an ordinary brace
        if int(low) > MAX_REPEAT or (high and not int(low) <= int(high) <= MAX_REPEAT):
            self.fail("invalid repeat count")
        self.at = end + 1
        return int(low), "{" + low + comma + high + "}"

    def atom(self, flags: frozenset) -> list:
        char = self.next()
        if char == "(":
            return [self.group(flags)]
        if char == "[":
            return [self.chars(self.bracket(flags))]
        if char == ".":
            return [self.chars(((0, MAX_CODE),) if "s" in flags else _complement(((10, 10),)))]
        if char == "^":
            return [Atom(self.assertions["line start"] if "m" in flags else "\\A", 0)]
        if char == "$":
            return [Atom(self.assertions["line end" if "m" in flags else "end"], 0)]
        if char in "*+?":
            self.fail("nothing to repeat")
        if char == "\\":
            return self.escape(flags)
        return [self.literal(ord(char), flags)]

    def literal(self, code: int, flags: frozenset) -> Atom:
        codes = _fold_char(code) if "i" in flags else {code}
        return self.chars([(c, c) for c in codes])

    def chars(self, ranges) -> Atom:
        return Atom(_class_text(ranges, self.dialect), 1, _merge(ranges))

    def group(self, flags: frozenset) -> Group:
        index = None
        if not self.take("?"):
            self.captures += 1
            index = self.captures
        elif self.take("P<") or (
            self.peek("<") and not self.peek("<=") and not self.peek("<!") and self.take("<")
        ):
            name = self.until(">")
            if not name.replace("_", "a").isalnum() or name in self.names:
                self.fail("bad group name")
            self.names.add(name)
            self.captures += 1
            index = self.captures
        else:
            letters = self.until(":")
            if letters.strip("imsU-"):
                self.fail("lookaround and other Perl groups are not supported")
            flags = self.apply_flags(flags, letters) if letters else flags
        branches = self.branches(flags)
        if not self.take(")"):
            self.fail("missing )")
        return Group(index, branches)

    def until(self, stop: str) -> str:
        end = self.source.find(stop, self.at)
        if end < 0:
            self.fail("unterminated group")
        text = self.source[self.at : end]
        self.at = end + 1
        return text

    def escape(self, flags: frozenset) -> list:
        if self.take("Q"):
            end = self.source.find("\\E", self.at)
            text = self.source[self.at : end if end >= 0 else len(self.source)]
            self.at += len(text) + (2 if end >= 0 else 0)
            return [self.literal(ord(c), flags) for c in text]
        for letter, text in (
            ("b", self.assertions["edge"]), ("B", self.assertions["inside"]),
            ("A", "\\A"), ("z", self.assertions["end"]),
        ):
            if self.take(letter):
                return [Atom(text, 0)]
        if self.take("C"):
            self.fail("single-byte \\C is not supported")
        ranges = self.class_escape(flags)
        if ranges is not None:
            return [self.chars(ranges)]
        return [self.literal(self.char_escape(), flags)]

    def class_escape(self, flags: frozenset) -> tuple | None:
        """``\\d \\w \\s \\pL`` after the backslash, or None."""
        for letter, ranges in (("d", DIGIT), ("s", SPACE), ("w", WORD)):
            if self.take(letter):
                return _fold(ranges) if "i" in flags else ranges
            if self.take(letter.upper()):
                return _complement(_fold(ranges) if "i" in flags else ranges)
        if not (self.peek("p") or self.peek("P")):
            return None
        negate = self.next() == "P"
        name = self.until("}") if self.take("{") else self.next()
        if name.startswith("^"):
            negate, name = not negate, name[1:]
        ranges = ((0, MAX_CODE),) if name == "Any" else _category(name)
        if not ranges:
            self.fail(f"unsupported Unicode class {name!r}")
        ranges = _fold(ranges) if "i" in flags else ranges
        return _complement(ranges) if negate else ranges

    def char_escape(self) -> int:
        char = self.next()
        simple = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
        if char in simple:
            return simple[char]
        if char == "x":
            digits = self.until("}") if self.take("{") else self.next() + self.next()
            try:
                code = int(digits, 16)
            except ValueError:
                self.fail("bad hexadecimal escape")
            if code > MAX_CODE:
                self.fail("bad hexadecimal escape")
            return code
        if char in "01234567":
            nearby = self.source[self.at : self.at + 2]
            octal = char + "".join(c for c in nearby if c in "01234567")
            if char != "0" and len(octal) < 2:
                self.fail("backreferences are not supported")
            octal = octal if nearby[:1] in tuple("01234567") else char
            self.at += len(octal) - 1
            return int(octal, 8)
        if char.isascii() and not char.isalnum():
            return ord(char)
        self.fail(f"unsupported escape \\{char}")

    def bracket(self, flags: frozenset) -> tuple:
        negate = self.take("^")
        ranges: list = []
        first = True
        while first or not self.peek("]"):
            first = False
            if self.peek("[:") and (end := self.source.find(":]", self.at)) > 0:
                name = self.source[self.at + 2 : end]
                found = POSIX.get(name.lstrip("^"))
                if found is None:
                    self.fail(f"unknown class [:{name}:]")
                found = _fold(found) if "i" in flags else found
                ranges.extend(_complement(found) if name.startswith("^") else found)
                self.at = end + 2
                continue
            if self.peek("\\"):
                mark = self.at
                self.at += 1
                found = self.class_escape(flags)
                if found is not None:
                    ranges.extend(found)
                    continue
                self.at = mark
            low = high = self.bracket_char()
            if self.peek("-") and not self.peek("-]"):
                self.at += 1
                high = self.bracket_char()
                if high < low:
                    self.fail("bad character range")
            span = ((low, high),)
            ranges.extend(_fold(span) if "i" in flags else span)
        self.at += 1
        return _complement(ranges) if negate else _merge(ranges)

    def bracket_char(self) -> int:
        char = self.next()
        return self.char_escape() if char == "\\" else ord(char)


@remembered
def parse(source: str, dialect: str = JAVA) -> Pattern:
    """Read an RE2 pattern; raises :class:`PatternError` if RE2 would reject it."""
    return _Reader(source, dialect).read()


def portable(source: str) -> str:
    """The pattern as java.util.regex text with RE2 meaning."""
    return parse(source).text
