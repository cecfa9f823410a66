"""Column functions over lines, secrets and fingerprints.

Lengths and offsets count bytes, as in the frozen finding schema, never
characters.  Everything here is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a finding shows a secret.
VISIBLE_FROM = 16
PEEK = 4
MASK = "****...****"
MASKED = "[REDACTED]"
HASH_DIGITS = 16
SHORT_SHA = 7
UNSAFE = "[\\x00-\\x08\\x0A-\\x1F\\x7F\\u2028\\u2029]"
LATIN = "ISO-8859-1"
RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"


def shannon_entropy(text: Column, size: Column | None = None) -> Column:
    """Bits per byte: characters are counted, the denominator is the byte length.

    ``size`` is the byte length where ``text`` stands for bytes that are not UTF-8.
    """
    scale = F.lit(1.0) / (F.octet_length(text) if size is None else size)

    def of(given: Column) -> Column:
        def add(total: Column, count: Column) -> Column:
            share = count * given["scale"]
            return total - share * F.log2(share)

        chars = F.array_distinct(F.split(given["text"], ""))
        # the size in bits is known of any text, its characters would be counted anew for every one of them
        counts = F.transform(
            chars,
            lambda c: F.call_function("div", given["bits"] - F.bit_length(F.replace(given["text"], c, F.lit(""))), F.bit_length(c)),
        )
        # sorted counts give one summation order, so equal secrets score equally
        return F.aggregate(F.sort_array(counts), F.lit(0.0), add)

    # the variable of a lambda holds what does not change: as an expression it would be evaluated for every character
    given = F.struct(text.alias("text"), scale.alias("scale"), F.bit_length(text).alias("bits"))
    return F.when(text == "", F.lit(0.0)).otherwise(F.transform(F.array(given), of)[0])


def redact_bytes(secret: Column) -> Column:
    """:func:`redact` on a binary column; the result is binary too."""
    shown = F.concat(
        F.substring(secret, 1, PEEK),
        F.lit(MASK.encode()),
        F.substring(secret, -PEEK, PEEK),
    )
    return F.when(F.octet_length(secret) < VISIBLE_FROM, F.lit(MASKED.encode())).otherwise(shown)


def redact(secret: Column) -> Column:
    """First and last four bytes around a mask; all masked below sixteen bytes."""
    return bytes_as_text(redact_bytes(secret.cast("binary")))


def bytes_as_text(value: Column) -> Column:
    """Binary to string; bytes that are not UTF-8 show as U+FFFD."""
    return F.make_valid_utf8(value.cast("string"))


def redact_all(match: Column, secret: Column) -> Column:
    """Replace every occurrence, for callers that do not know the span."""
    return F.when(secret == "", match).otherwise(F.replace(match, secret, redact(secret)))


def redact_at(match: Column, secret: Column, offset: Column) -> Column:
    """Replace the secret at the 0-based byte offset, or everywhere if it is not there."""
    raw, key = match.cast("binary"), secret.cast("binary")
    size = F.octet_length(secret)
    found = (offset >= 0) & (F.substring(raw, offset + 1, size) == key)
    spanned = F.concat(
        F.substring(raw, F.lit(1), offset),
        redact_bytes(key),
        F.substring(raw, offset + 1 + size, F.octet_length(match)),
    )
    return F.when(found, bytes_as_text(spanned)).otherwise(redact_all(match, secret))


def as_characters(text: Column) -> Column:
    """Text that is not UTF-8, read one character per byte.

    Splitting and matching work on characters and would replace stray bytes;
    seen this way none is lost. :func:`from_characters` turns pieces back.
    """
    latin = F.decode(text.cast("binary"), LATIN)
    return F.when(F.is_valid_utf8(text), text).otherwise(latin)


def from_characters(piece: Column, latin: Column) -> Column:
    return F.when(latin, F.encode(piece, LATIN).cast("string")).otherwise(piece)


def secret_hash(secret: Column) -> Column:
    return F.sha2(secret.cast("binary"), 256)


def fingerprint(path: Column, rule_id: Column, secret: Column) -> Column:
    """``path:rule:hash`` — independent of line, column and commit."""
    return F.concat_ws(
        ":",
        F.translate(path, "\\", "/"),
        rule_id,
        F.substring(secret_hash(secret), 1, HASH_DIGITS),
    )


def content_key(fingerprint: Column) -> Column:
    """``rule:hash`` — what is left of a fingerprint when the file moves."""
    return F.substring_index(fingerprint, ":", -2)


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, SHORT_SHA)


def sanitize_text(text: Column) -> Column:
    """Neutralise terminal control characters; nothing is cut, so a printed fingerprint can be used."""
    return F.regexp_replace(text, UNSAFE, "�")


def format_duration(milliseconds: Column) -> Column:
    """``40ms`` below a tenth of a second, else ``1.2s``, rounded from the exact binary value."""
    seconds = F.floor(milliseconds / 1000).cast("double") + (milliseconds % 1000) / F.lit(1000.0)
    long = F.concat(F.call_function("format_number", seconds, F.lit("0.0")), F.lit("s"))
    return F.when(milliseconds < 100, F.format_string("%dms", milliseconds)).otherwise(long)


def rfc3339(timestamp: Column) -> Column:
    """A commit time given as a timestamp, as the text the findings carry."""
    return F.date_format(timestamp, RFC3339)


def drop_cr(line: Column) -> Column:
    ends = F.endswith(line, F.lit("\r"))
    return F.when(ends, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def file_lines(text: Column) -> Column:
    """Lines of a file's text: a newline at the very end starts no further line."""
    parts = F.split(text, "\n")
    closed = (text == "") | F.endswith(text, F.lit("\n"))
    return F.when(closed, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
