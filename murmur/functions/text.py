"""Text functions: whitespace, script, digests, byte decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` accepts, as a regex class.
# Java's own \s is ASCII only, so the class is spelled out.
UNICODE_SPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
# The channel reader keeps newlines and collapses only these.
INLINE_SPACE = r"[ \t\r\f\x0b]"

# The Georgian block and the ASCII letters.
GEORGIAN = r"[\x{10a0}-\x{10ff}]"
LATIN = r"[A-Za-z]"

HASH_HEX = r"\A[0-9a-f]{64}\z"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.regexp_replace(
        text, rf"\A{UNICODE_SPACE}+|{UNICODE_SPACE}+\z", ""
    )


def collapse_whitespace(text: Column) -> Column:
    """Each run of whitespace becomes one space; none at either end."""
    return F.trim(F.regexp_replace(text, f"{UNICODE_SPACE}+", " "))


def collapse_inline(text: Column) -> Column:
    """Collapse spaces and tabs but keep line breaks; then strip both ends."""
    return strip(F.regexp_replace(text, f"{INLINE_SPACE}+", " "))


def script_of(text: Column) -> Column:
    """``georgian``, ``latin`` or null for text without letters of either."""
    georgian = F.regexp_count(text, F.lit(GEORGIAN))
    latin = F.regexp_count(text, F.lit(LATIN))
    return (
        F.when((georgian == 0) & (latin == 0), F.lit(None).cast("string"))
        .when(georgian >= latin, F.lit("georgian"))
        .when(georgian < latin, F.lit("latin"))
    )


def text_digest(text: Column) -> Column:
    """Hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def bytes_digest(data: Column) -> Column:
    return F.sha2(data, 256)


def is_digest(text: Column) -> Column:
    """Exactly 64 lower-case hex digits. Null is not a digest."""
    return F.coalesce(text.rlike(HASH_HEX), F.lit(False))


def decode_utf8(data: Column) -> tuple[Column, Column]:
    """(text, was_valid): invalid bytes become U+FFFD, and the flag says so."""
    as_text = data.cast("string")
    return F.make_valid_utf8(as_text), F.is_valid_utf8(as_text)


def float_text(value: Column) -> Column:
    """A double the way Python's ``repr`` prints it.

    Java switches to exponents at 1e-3 and 1e7, Python at 1e-4 and 1e16. Between
    those the digits are the same and only need writing out.
    """
    java = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(
        java.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+\z", "$1"
    )
    mantissa = F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), r"\.0\z", "")
    exponent = F.split_part(java, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    digits = F.abs(exponent).cast("string")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    scientific = F.concat(mantissa, F.lit("e"), sign, padded)
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
