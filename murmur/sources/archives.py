"""Archives: gzip members holding one record each, read in bulk.

Input is the shape Spark's ``binaryFile`` source gives (path, content). A record is
returned whether or not anything expected it, so that an extra one is seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Record addresses. Pass the prefix your own archives were written with.
URI_PREFIX = "urn:evidence"

# Artifacts that hold the captured document, best first.
DOCUMENT_ARTIFACTS = ["dom.html", "dom.html.gz"]

#: ``problem`` says what could not be read; such a row stands for bytes, not for a record.
RECORD_SCHEMA = (
    "path string, record_no long, uri string, media_type string, payload binary, problem string"
)

#: Bytes that are handed on at once, and rows.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096

_HEADER = re.compile(rb"WARC/1\.\d\r\n(.*?)\r\n\r\n", re.S)


def _unpacked(raw: bytes) -> tuple[bytes, str | None]:
    """The bytes of all gzip members, as far as they can be read, and what stopped it."""
    if raw[:2] != b"\x1f\x8b":
        return raw, None
    parts, rest = [], raw
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            parts.append(member.decompress(rest))
        except zlib.error:
            return b"".join(parts), "gzip damaged"
        if not member.eof:
            return b"".join(parts), "gzip cut short"
        rest = member.unused_data
    return b"".join(parts), "bytes after the last gzip member" if rest.strip(b"\0") else None


def _records(raw: bytes) -> Iterator[tuple[str | None, str | None, bytes | None, str | None]]:
    """Records in order; unread bytes give a row with a problem instead of silence."""
    data, trouble = _unpacked(raw)
    at, seen = 0, False
    while at < len(data):
        head = _HEADER.match(data, at)
        if head is None:
            # what lies between is reported, and reading goes on at the next header
            following = _HEADER.search(data, at)
            yield None, None, None, "bytes that are no record"
            if following is None:
                break
            at = following.start()
            continue
        headers = {}
        for line in head.group(1).split(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        size = int(length) if length.isascii() and length.isdigit() else None
        start = head.end()
        payload = data[start : start + (size or 0)]
        problem = None
        if size is None:
            problem = "length of the payload not known"
        elif len(payload) < size:
            problem = "payload shorter than its length"
        seen = True
        yield (
            headers.get("warc-target-uri", ""), headers.get("content-type", ""), payload, problem
        )
        at = start + len(payload)
        while data[at : at + 2] == b"\r\n":
            at += 2
    if trouble or not seen:
        yield None, None, None, trouble or "no record"


def framed(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most BATCH_ROWS rows that end once their bytes and texts pass BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes | str))
        if size > BATCH_BYTES or len(held) == BATCH_ROWS:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def read_archives(files: DataFrame) -> DataFrame:
    """(path, content) to one row per record, in archive order.

    Every file gives at least one row. Damage gives a row, or marks its record, with
    ``problem``; it never ends the job nor hides what follows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (
            (path, i, *record)
            for batch in batches
            for path, content in zip(batch["path"], batch["content"], strict=True)
            for i, record in enumerate(_records(bytes(content or b"")))
        )
        yield from framed(rows, ["path", "record_no", "uri", "media_type", "payload", "problem"])

    return files.select("path", "content").mapInPandas(scan, RECORD_SCHEMA)


def artifacts(records: DataFrame, prefix: str = URI_PREFIX) -> DataFrame:
    """Artifact records with the name taken from the address."""
    lead = f"{prefix}:artifact:"
    return records.where(F.col("uri").startswith(lead)).select(
        "path", "record_no", F.substr(F.col("uri"), F.lit(len(lead) + 1)).alias("name"),
        "payload",
    )


def manifests(records: DataFrame, prefix: str = URI_PREFIX) -> DataFrame:
    """The first manifest record of each archive."""
    return (
        records.where(F.col("uri") == f"{prefix}:manifest")
        .groupBy("path")
        .agg(F.min_by("payload", "record_no").alias("manifest"))
    )


def latest_seals(records: DataFrame, prefix: str = URI_PREFIX) -> DataFrame:
    """Seals are appended; the last one counts."""
    return (
        records.where(F.col("uri") == f"{prefix}:seal")
        .groupBy("path")
        .agg(F.max_by("payload", "record_no").alias("seal"), F.count("*").alias("seals"))
    )


def capture_documents(bundles: DataFrame, records: DataFrame, prefix: str = URI_PREFIX):
    """The document of each capture, from its latest bundle.

    ``bundles`` has tenant_id, capture_id, bundle_id, captured_at and path. A capture whose
    archive is gone comes back with a null document.
    """
    latest = bundles.groupBy("tenant_id", "capture_id").agg(
        F.max_by("path", F.struct("captured_at", "bundle_id")).alias("path")
    )
    rank = F.lit(None).cast("int")
    for position, name in reversed(list(enumerate(DOCUMENT_ARTIFACTS))):
        rank = F.when(F.col("name") == name, F.lit(position)).otherwise(rank)
    documents = (
        artifacts(records, prefix)
        .withColumn("rank", rank)
        .where(F.col("rank").isNotNull())
        .groupBy("path")
        .agg(F.min_by("payload", F.struct("rank", -F.col("record_no"))).alias("document"))
    )
    return latest.join(documents, "path", "left").select(
        "tenant_id", "capture_id", "path", "document"
    )
