"""Archives as files: a data source that splits them by ranges of gzip members.

``spark.read.format("archive").load(path)`` plans one partition for each ``splitBytes`` of
each file, so a large archive is many tasks. A task owns the members that begin in its
range: it looks for the first place where a member begins and unpacks to a record, and
reads on past its end to finish the last one. What lies between two members belongs to
the task of the first. Nothing is held but a buffer and, unless option ``payload`` is
``false``, one payload; size and digest are taken while bytes pass by, so records beyond
2 GB can be verified without their payload.

Damage gives a row with ``problem`` and the offset where it begins, and reading goes on
at the next member. Every file gives a row. A file that is not packed is one partition.
``record_no`` grows with the place in the file. A payload that did not shrink and itself
holds a packed record may give that record as well, where a range begins inside it. Files are opened through Arrow's file
systems (local and shared folders, HDFS, S3 and the like).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from murmur.sources.archives import RECORD_SCHEMA

#: Bytes of a file that one task begins in, bytes read and unpacked at once.
SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20
#: Bytes in which a record's header has to end.
HEADER_BYTES = 1 << 20
SCHEMA = RECORD_SCHEMA.replace("payload binary", "size long, sha256 string, payload binary")
COLUMNS = ("path", "record_no", "uri", "media_type", "size", "sha256", "payload", "problem")
MAGIC, LEAD = b"\x1f\x8b\x08", b"WARC/1."


@dataclass
class Range(InputPartition):
    path: str
    lo: int
    hi: int
    packed: bool


def opened(path: str):
    files, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return files, inner


class Member:
    """Unpacked bytes of one gzip member, a chunk at a time, or of a plain file."""

    def __init__(self, file, at: int, packed: bool):
        self.file, self.at, self.packed = file, at, packed
        self.unpack = zlib.decompressobj(wbits=31) if packed else None
        self.raw, self.trouble, self.done = b"", None, False
        file.seek(at)

    def read(self) -> bytes:
        """The next bytes; none at the end. ``at`` moves behind what was used."""
        while not self.done:
            if not self.raw:
                self.raw = self.file.read(CHUNK)
                if not self.raw:
                    self.done = True
                    self.trouble = "gzip cut short" if self.packed else None
                    return b""
            if not self.packed:
                out, self.raw = self.raw, b""
                self.at += len(out)
                return out
            given = len(self.raw)
            try:
                out = self.unpack.decompress(self.raw, CHUNK)
            except zlib.error:
                self.done, self.trouble = True, "gzip damaged"
                return b""
            if self.unpack.eof:
                self.done, self.raw = True, self.unpack.unused_data
                self.at += given - len(self.raw)
            else:
                self.raw = self.unpack.unconsumed_tail
                self.at += given - len(self.raw)
            if out:
                return out
        return b""


def records(member: Member, keep: bool) -> Iterator[tuple]:
    """(uri, media_type, size, sha256, payload, problem) of the records of a member, in order."""
    held, more = b"", True

    def fill(least: int) -> None:
        nonlocal held, more
        parts, n = [held], len(held)
        while n < least and more:
            part = member.read()
            more = bool(part)
            parts.append(part)
            n += len(part)
        held = b"".join(parts)

    junk = False
    while True:
        fill(1)
        held = held.lstrip(b"\r\n")
        if not held and not more:
            break
        while (end := held.find(b"\r\n\r\n")) < 0 and len(held) < HEADER_BYTES and more:
            fill(len(held) + 1)
        if not held:
            break
        if end < 0 or not held.startswith(LEAD):
            if not junk:
                yield None, None, None, None, None, "bytes that are no record"
            junk = True
            at = held.find(LEAD, 1)
            if at < 0 and not more:
                break
            held = held[at:] if at > 0 else held[-len(LEAD) + 1 :]
            if at < 0:
                fill(len(held) + 1)
            continue
        junk = False
        headers = {}
        for line in held[:end].split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        held = held[end + 4 :]
        length = headers.get("content-length", "")
        known = length.isascii() and length.isdigit()
        left, digest, kept, size = int(length) if known else 0, hashlib.sha256(), [], 0
        while left:
            fill(1)
            part, held = held[:left], held[left:]
            if not part:
                break
            digest.update(part)
            size, left = size + len(part), left - len(part)
            if keep:
                kept.append(part)
        problem = None if known and not left else "payload shorter than its length" if known else "length of the payload not known"
        yield headers.get("warc-target-uri", ""), headers.get("content-type", ""), size, digest.hexdigest(), b"".join(kept) if keep else None, problem


def begins(file, at: int) -> bool:
    """Whether a gzip member that unpacks to a record begins here."""
    file.seek(at)
    raw = file.read(4096)
    if raw[:3] != MAGIC:
        return False
    try:
        return zlib.decompressobj(wbits=31).decompress(raw, len(LEAD)).startswith(LEAD)
    except zlib.error:
        return False


def next_member(file, at: int, end: int) -> int | None:
    """The first place from ``at`` on and before ``end`` where a member with a record begins."""
    while at < end:
        file.seek(at)
        part = file.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        found = part.find(MAGIC)
        while found >= 0:
            if at + found < end and begins(file, at + found):
                return at + found
            found = part.find(MAGIC, found + 1)
        at += CHUNK
    return None


def scan(split: Range, keep: bool = True) -> Iterator[tuple]:
    """Rows of the records that begin in a range of a file."""
    files, inner = opened(split.path)
    with files.open_input_file(inner) as file:
        size, count = file.size(), 0

        def row(at: int, index: int, values: tuple) -> tuple:
            nonlocal count
            count += 1
            return split.path, at << 24 | index, *values

        def trouble(at: int, what: str) -> tuple:
            return row(at, (1 << 24) - 1, (None, None, None, None, None, what))

        if not split.packed:
            for i, found in enumerate(records(Member(file, 0, False), keep)):
                yield row(0, i, found)
        else:
            at = next_member(file, split.lo, split.hi)
            if split.lo == 0 and at != 0 and size:
                yield trouble(0, "bytes before the first record")
            while at is not None and at < split.hi:
                member = Member(file, at, True)
                for i, found in enumerate(records(member, keep)):
                    yield row(at, i, found)
                while not member.done:
                    member.read()
                if member.trouble:
                    yield trouble(at, member.trouble)
                    at = next_member(file, at + 1, split.hi)
                    continue
                behind, at = member.at, member.at
                # padding with zeros is usual at the end of an archive
                while at < size:
                    file.seek(at)
                    part = file.read(CHUNK)
                    if not part.strip(b"\0"):
                        at += len(part)
                        continue
                    at += len(part) - len(part.lstrip(b"\0"))
                    break
                if at < size and not begins(file, at):
                    yield trouble(behind, "bytes after a gzip member")
                    at = next_member(file, at, split.hi)
        if not count and split.lo == 0:
            yield trouble(0, "no record")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int, keep: bool):
        self.path, self.split, self.keep = path, split, keep

    def partitions(self) -> list[Range]:
        files, inner = opened(self.path)
        info = files.get_file_info(inner)
        every = [info]
        if info.type == fs.FileType.Directory:
            every = [f for f in files.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        lead = self.path[: self.path.index(inner)] if inner in self.path else ""
        out = []
        for f in sorted(every, key=lambda f: f.path):
            with files.open_input_file(f.path) as file:
                packed = f.base_name.endswith(".gz") or file.read(2) == MAGIC[:2]
            cuts = range(0, max(f.size, 1), self.split) if packed else [0]
            out += [Range(lead + f.path, lo, min(lo + self.split, max(f.size, 1)) if packed else f.size, packed) for lo in cuts]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return scan(partition, self.keep)


class ArchiveSource(DataSource):
    """Options: ``path``, ``splitBytes``, ``payload`` (``false``: size and digest alone)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(
            self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)),
            self.options.get("payload", "true").lower() != "false",
        )


def read(spark, path: str, split: int = SPLIT_BYTES, payload: bool = True):
    """Records of the archives in a file or folder."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("splitBytes", split).option("payload", str(payload).lower()).load(path)
