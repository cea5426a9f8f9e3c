"""Text functions of payloads and labels, as columns.

A payload is a string column, or a binary one, which is then read byte by byte (as ISO-8859-1) where
bytes count and as UTF-8 with replacement where characters do.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming of lines removes, and what stripping of payloads removes besides.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = "\x1c\x1d\x1e\x1f"
MIN_LEN, MIN_PRINTABLE_RATIO = 4, 0.30


def trim_unicode(c: Column) -> Column:
    """Without the white space of Unicode at both ends; each end is walked once."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip(c: Column) -> Column:
    """Without white space and the four information separators at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE + SEPARATORS))


def as_bytes_text(c: Column, binary: bool = False) -> Column:
    """A string with one character for each byte if the column is binary; else the string itself."""
    return F.decode(c, "ISO-8859-1") if binary else c


def as_text(c: Column, binary: bool = False) -> Column:
    """UTF-8 with the replacement character for what isn't valid."""
    return F.make_valid_utf8(c.cast("string")) if binary else c


def ascii_lower(c: Column) -> Column:
    """A to Z in lower case; every other character stays, whatever its case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def printable_ratio(c: Column, binary: bool = False) -> Column:
    """Share of bytes that are tab, line feed, carriage return or from space to tilde; 0 for an empty payload."""
    t = as_bytes_text(c, binary)
    size = F.length(t) if binary else F.octet_length(t)
    kept = F.length(F.regexp_replace(t, r"[^\x09\x0A\x0D\x20-\x7E]", ""))
    return F.when(size == 0, F.lit(0.0)).otherwise(kept / size)


def is_printable_enough(c: Column, min_ratio: float = MIN_PRINTABLE_RATIO, binary: bool = False) -> Column:
    return printable_ratio(c, binary) >= min_ratio


def is_printable(c: Column, threshold: float = MIN_PRINTABLE_RATIO, binary: bool = False) -> Column:
    """As is_printable_enough, but false for empty payloads whatever the threshold."""
    return (F.octet_length(c) > 0) & is_printable_enough(c, threshold, binary)


def clean_text(c: Column, binary: bool = False) -> Column:
    """Stripped, without control characters but tabs, and stripped again."""
    return strip(F.regexp_replace(strip(as_text(c, binary)), r"[\x00-\x08\x0A-\x1F]", ""))


def clean_line(c: Column, min_len: int = MIN_LEN, binary: bool = False) -> Column:
    """The cleaned text, or null if it has fewer than min_len characters."""
    # an array of one is a let: the line is made once, though it is named twice
    once = F.transform(F.array(clean_text(c, binary)), lambda x: F.when(F.length(x) >= min_len, x))
    return F.get(once, F.lit(0))


def bytes_to_line(c: Column, min_len: int = MIN_LEN, threshold: float = MIN_PRINTABLE_RATIO, binary: bool = False) -> Column:
    """clean_line of payloads that are printable enough; null for others."""
    return F.when(is_printable(c, threshold, binary), clean_line(c, min_len, binary))


def slugify(c: Column) -> Column:
    """ASCII letters and digits, with one hyphen for each run of other ASCII characters within; else unknown."""
    ascii_only = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    joined = F.regexp_replace(F.regexp_replace(ascii_only, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("unknown"))


# What a label of this category is called, by the first keyword that it holds.
SUBTYPES = (("brute force", "Brute-Force"), ("xss", "XSS"), ("sql injection", "SQL-Injection"))


def subtype_slug(c: Column) -> Column:
    low, out = F.lower(c), None
    for keyword, slug in SUBTYPES:
        out = (F if out is None else out).when(low.contains(keyword), slug)
    return out.otherwise(slugify(c))


def reservoir_name(category: Column, sublabel: Column) -> Column:
    """The stem of a reservoir's files; an empty or null sublabel adds nothing."""
    return F.replace(F.concat_ws("_", category, F.nullif(sublabel, F.lit(""))), F.lit(" "), F.lit("_"))


def payload_digest(c: Column) -> Column:
    """A digest that tells payloads apart; nothing depends on which."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 32)


def starts_with_credential(c: Column, keywords: tuple[str, ...] = ("USER", "PASS")) -> Column:
    """Whether the payload, in upper-case ASCII, begins with one of the keywords."""
    upper = F.translate(c, string.ascii_lowercase, string.ascii_uppercase)
    out = F.lit(False)
    for k in keywords:
        out = out | upper.startswith(k)
    return out


def byte_bits(c: Column) -> Column:
    """The eight bits of a number from 0 to 255, lowest first, as booleans."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit(c.cast("int"), i) == 1)


def payload_bytes(c: Column) -> Column:
    """The bytes of a string or binary column as an array of numbers."""
    raw, size = c.cast("binary"), F.octet_length(c)
    each = F.transform(F.sequence(F.lit(1), size), lambda i: F.conv(F.hex(F.substr(raw, i, F.lit(1))), 16, 10).cast("int"))
    return F.when(size > 0, each).otherwise(F.array().cast("array<int>"))


def bit_matrix(c: Column) -> Column:
    """The bits of every byte, lowest first."""
    return F.transform(payload_bytes(c), byte_bits)


def zero_padded(c: Column, length: int) -> Column:
    """Binary, filled with zero bytes up to length."""
    missing = F.greatest(F.lit(length) - F.octet_length(c), F.lit(0))
    return F.concat(c.cast("binary"), F.unhex(F.repeat(F.lit("00"), missing)))


def byte_equal(a: Column, b: Column) -> Column:
    """Bit by bit equality of two arrays of bits."""
    return F.forall(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)


def escaped_cell(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("\\_"))


def padded(c: Column, width: int) -> Column:
    """Filled with spaces on the right; longer strings stay whole."""
    return F.rpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(" "))
