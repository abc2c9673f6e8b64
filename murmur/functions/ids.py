"""Deterministic identifiers and the length-prefixed encoding that is hashed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces the identifiers are derived in.
CONTENT_NAMESPACE = "6f1d5c40-0000-4000-8000-a51900000002"
SOURCE_NAMESPACE = "5b2c7e14-0000-4000-8000-a51900000006"
STIX_NAMESPACE = "00abedb4-aa42-466c-9c01-fed23315a9b7"


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 UUID as canonical text."""
    seed = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(seed, F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def account_id(platform: Column, handle: Column) -> Column:
    return uuid5(CONTENT_NAMESPACE, F.concat_ws("|", F.lit("account"), platform, handle))


def content_id(platform: Column, external_id: Column) -> Column:
    return uuid5(CONTENT_NAMESPACE, F.concat_ws("|", F.lit("content"), platform, external_id))


def source_id(platform: Column, url: Column) -> Column:
    return uuid5(SOURCE_NAMESPACE, F.concat_ws("|", F.lit("source"), platform, url))


def export_id(object_type: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{object_type}--"), uuid5(STIX_NAMESPACE, F.concat_ws("|", *parts)))


def length_prefixed(*fields: Column) -> Column:
    """Each field as an 8-byte big-endian length followed by its UTF-8 bytes."""
    pieces = []
    for field in fields:
        data = F.encode(field, "UTF-8")
        pieces.append(F.unhex(F.lpad(F.hex(F.octet_length(field)), 16, "0")))
        pieces.append(data)
    return reduce(lambda a, b: F.concat(a, b), pieces[2:], F.concat(*pieces[:2]))


def prefixed_digest(*fields: Column) -> Column:
    return F.sha2(length_prefixed(*fields), 256)
