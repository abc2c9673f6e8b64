"""Byte-exact JSON text.

``to_json`` neither sorts keys nor escapes non-ASCII, so documents that are hashed
are put together from their parts. A part is a string column holding JSON text.
Documents whose keys are not known beforehand go through :func:`canonical`.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.text import float_text

# Escapes of the control characters; the common three are handled apart.
COMMON_ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
RARE_ESCAPES = {"\b": "\\b", "\f": "\\f"}
RARE_CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def string(value: Column, ascii_only: bool = False) -> Column:
    """A quoted JSON string; null becomes ``null``. Non-ASCII is kept unless ``ascii_only``."""
    safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, escape in COMMON_ESCAPES.items():
        safe = F.replace(safe, F.lit(char), F.lit(escape))
    names = [RARE_ESCAPES.get(chr(c), f"\\u{c:04x}") for c in range(32)]
    spelled = F.split(F.lit(",".join(names)), ",")

    def escaped(char: Column) -> Column:
        control = (F.length(char) > 0) & (F.ascii(char) < 32)
        kept = _unicode_escape(char) if ascii_only else char
        return F.when(control, F.get(spelled, F.ascii(char))).otherwise(kept)

    # Only texts with such a character are walked character by character.
    unusual = value.rlike(RARE_CONTROLS + (r"|[^\x00-\x7f]" if ascii_only else ""))
    body = F.when(
        unusual, F.array_join(F.transform(F.split(safe, ""), escaped), "")
    ).otherwise(safe)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def _unicode_escape(char: Column) -> Column:
    """``\\uXXXX`` for a non-ASCII character (a surrogate pair above U+FFFF)."""
    code = F.ascii(char)

    def unit(value: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(value), 4, "0")))

    high = F.lit(0xD800) + F.floor((code - 0x10000) / 0x400).cast("int")
    low = F.lit(0xDC00) + F.pmod(code - 0x10000, F.lit(0x400))
    return (
        F.when(code < 0x80, char)
        .when(code < 0x10000, unit(code))
        .otherwise(F.concat(unit(high), unit(low)))
    )


def integer(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def double(value: Column) -> Column:
    return F.coalesce(float_text(value), F.lit("null"))


def boolean(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def array(parts: Column) -> Column:
    """From an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def obj(fields: Mapping[str, Column]) -> Column:
    """Keys in sorted order, no spaces."""
    pieces: list[Column] = []
    for position, key in enumerate(sorted(fields)):
        lead = "{" if position == 0 else ","
        pieces += [F.lit(f'{lead}"{key}":'), fields[key]]
    return F.concat(*pieces, F.lit("}"))


def text(value: str, ascii_only: bool = False) -> Column:
    """A constant string."""
    return F.lit(json.dumps(value, ensure_ascii=ascii_only))


def _canonical(document: str | None) -> str | None:
    def refuse(constant: str):
        raise ValueError(constant)

    try:
        held = json.loads(document, parse_constant=refuse)
        out = json.dumps(held, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        out.encode()
    except (TypeError, ValueError, RecursionError):
        return None
    return out


@F.pandas_udf(T.StringType())
def _canonical_udf(documents: pd.Series) -> pd.Series:
    return documents.map(_canonical)


def canonical(document: Column) -> Column:
    """Any JSON document with keys sorted at every level and no spaces; non-ASCII is kept.

    Keys sort by code point, of equal keys the last counts. Whole numbers keep all digits,
    others take their shortest exact form. Null where the text is null, is no JSON, holds
    NaN, an infinity or half a surrogate pair, or nests deeper than can be read; such
    documents cannot be hashed, and callers treat a null digest as a refusal. Keys are
    data here, which built-in functions cannot sort at every level, so this runs on Arrow batches.
    """
    return _canonical_udf(document)
