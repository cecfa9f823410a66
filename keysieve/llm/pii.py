"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and reports anchors: at-signs,
plus signs, digits, URI schemes and words that announce an identifier. Around
each anchor a small deterministic parser finds the borders and validates. The
four base kinds (email, ip, card, phone) follow fixed grammars, leftmost and
without overlap within a kind; the anchors add ``uri`` and ``account`` spans.
One narrow pass, nothing shuffled, linear in the text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.common import per_batch, valid_text, worker_memory

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "uri", "account")
BATCH_ROWS = 512
# Characters of the base grammars, schemes, and words that announce an identifier.
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
CUES = ("iban", "account number", "account no", "acct", "ssn", "social security number", "passport", "tax id")
URI_END = frozenset(" \t\n\r\x0b\x0c<>\"'`|{}")
TRAILING = ".,;:!?)]"
SPAN = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
         T.StructField("value", T.StringType())]
    )
)

def automaton():
    """One automaton per worker over anchors: (kind of anchor, its length)."""
    known = worker_memory()
    if "anchors" not in known:
        import ahocorasick

        found = ahocorasick.Automaton()
        found.add_word("@", ("at", 1))
        found.add_word("+", ("plus", 1))
        for digit in DIGITS:
            found.add_word(digit, ("digit", 1))
        for scheme in SCHEMES:
            for form in {scheme, scheme.upper(), scheme.capitalize()}:
                found.add_word(form, ("scheme", len(form)))
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(form, ("cue", len(form)))
        found.make_automaton()
        known["anchors"] = found
    return known["anchors"]


def run_of(text: str, at: int, allowed: frozenset) -> int:
    """The end of the run of allowed characters from ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, not reaching back before ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = run_of(text, at + 1, LABEL)
    if end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == ".":
        next_end = run_of(text, end + 1, LABEL)
        if next_end == end + 1:
            break
        end, labels = next_end, labels + 1
    return (start, end) if labels > 1 else None


def ip_from(text: str, start: int) -> tuple[int, bool] | None:
    """Four runs of digits joined by points: the end, and whether all are at most 255."""
    end, valid = start, True
    for part in range(4):
        if part:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        stop = run_of(text, end, DIGITS)
        if stop == end:
            return None
        number = text[end:stop].lstrip("0")
        valid = valid and (len(number) < 3 or (len(number) == 3 and number <= "255"))
        end = stop
    return end, valid


def card_from(text: str, start: int) -> int:
    """The end of digits that single spaces or hyphens may part; ``start`` is a digit."""
    end, n = start + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if i % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join([c for c in text if c in DIGITS])


def phone_from(text: str, plus: int) -> int | None:
    """The end of a number after a plus sign: digit, at least one more character, digit."""
    first = plus + 1
    if first >= len(text) or text[first] not in DIGITS:
        return None
    end = run_of(text, first + 1, PHONE)
    while end > first + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > first + 2 and text[end - 1] in DIGITS else None


def uri_from(text: str, start: int, after: int) -> int | None:
    """The end of an address after its scheme, without closing punctuation."""
    end, n = after, len(text)
    while end < n and text[end] not in URI_END:
        end += 1
    while end > after and text[end - 1] in TRAILING:
        end -= 1
    return end if end > after else None


def iban_valid(compact: str) -> bool:
    """The mod-97 check of an international bank account number."""
    if not (15 <= len(compact) <= 34 and compact[:2].isalpha() and compact[2:4].isdigit()):
        return False
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def account_after(text: str, cue: int, after: int) -> tuple[int, int] | None:
    """The identifier that a cue announces: 6 to 34 letters and digits, half of them digits at least."""
    if cue and text[cue - 1] in ALNUM or after < len(text) and text[after] in ALNUM:
        return None
    start = after
    while start < len(text) and start < after + 4 and text[start] in " :#=.-":
        start += 1
    end, n = start, len(text)
    while end < n and (text[end] in ALNUM or (text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS and end > start
                                              and text[end - 1] in ALNUM)):
        end += 1
    compact = "".join([c for c in text[start:end] if c in ALNUM])
    digits = len(only_digits(compact))
    if iban_valid(compact.upper()) or (6 <= len(compact) <= 34 and 2 * digits >= len(compact)):
        return start, end
    return None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` in code points, by start, then kind as listed."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    after_email = after_ip = after_card = after_phone = after_uri = after_account = 0
    for last, (kind, length) in automaton().iter(text):
        start = last - length + 1
        if kind == "digit":
            if start >= after_card:
                after_card = card_from(text, start)
                digits = only_digits(text[start:after_card])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", start, after_card))
            if start >= after_ip:
                address = ip_from(text, start)
                if address is None:
                    after_ip = run_of(text, start, DIGITS)
                else:
                    after_ip, valid = address
                    if valid:
                        found.append(("ip", start, after_ip))
        elif kind == "at":
            address = email_at(text, start, after_email)
            if address:
                found.append(("email", *address))
                after_email = address[1]
        elif kind == "plus":
            if start >= after_phone:
                end = phone_from(text, start)
                if end is not None:
                    after_phone = end
                    if 9 <= len(only_digits(text[start:end])) <= 15:
                        found.append(("phone", start, end))
        elif kind == "scheme":
            if start >= after_uri and not (start and text[start - 1] in ALNUM):
                end = uri_from(text, start, last + 1)
                if end is not None:
                    found.append(("uri", start, end))
                    after_uri = end
        elif start >= after_account:
            account = account_after(text, start, last + 1)
            if account:
                found.append(("account", *account))
                after_account = account[1]
    found.sort(key=lambda span: (span[1], KINDS.index(span[0])))
    return found


def scan(frame: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, spans)``: for each row, its spans with kind, start, end and value.

    Offsets count code points, ends are exclusive. A null or empty text has no
    spans. Rows that repeat and null keys are kept; further columns are not looked
    at; an empty frame gives none. Texts of any length are scanned whole.
    """
    source = frame.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("spans", SPAN)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            rows.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in find(text)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow)], [key, "spans"])

    return source.mapInArrow(per_batch(work, BATCH_ROWS), schema)


def listing(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and the list of all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(
        key, *counts, F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans")
    )


def redact(frame: DataFrame, text: str = "text") -> DataFrame:
    """The frame with every span of its text replaced by its kind in angle brackets.

    Where spans overlap, the earliest, then the longest, is replaced.
    """

    @F.pandas_udf(T.StringType())
    def masked(texts):
        import pandas as pd

        return pd.Series([mask(t) for t in texts], dtype=object)

    return frame.withColumn(text, masked(valid_text(text)))


def mask(text: str | None) -> str | None:
    if not text:
        return text
    pieces, at = [], 0
    for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            pieces += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*pieces, text[at:]])
