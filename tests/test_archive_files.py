import gzip
import hashlib
import random

import pytest

from murmur.sources import archive_files, archives
from murmur.sources.archive_files import Range, scan


def member(uri, payload, length=None):
    head = f"WARC/1.1\r\nWARC-Target-URI: {uri}\r\nContent-Type: t\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n"
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", 6, mtime=0)


def in_ranges(path, split, packed=True, keep=True):
    size = max(path.stat().st_size, 1)
    rows = [r for lo in range(0, size, split) for r in scan(Range(str(path), lo, min(lo + split, size), packed), keep)]
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
    return rows


@pytest.mark.parametrize("split", [50, 333, 5000, 1 << 30])
def test_every_member_is_read_once_whatever_the_ranges(tmp_path, monkeypatch, split):
    monkeypatch.setattr(archive_files, "CHUNK", 97)
    rng = random.Random(4)
    payloads = [rng.randbytes(rng.choice([0, 1, 30, 400, 3000])) for _ in range(40)]
    payloads[7] = b"\x1f\x8b\x08" * 100 + member("inner", b"a member inside a member")
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(member(f"u{i}", p) for i, p in enumerate(payloads)) + b"\0" * 300)
    rows = in_ranges(path, split)
    outer = [r for r in rows if r[2] != "inner"]
    assert [(r[2], r[6], r[7]) for r in outer] == [(f"u{i}", p, None) for i, p in enumerate(payloads)]
    assert [(r[4], r[5]) for r in outer] == [(len(p), hashlib.sha256(p).hexdigest()) for p in payloads]
    assert all(r[6] is None for r in in_ranges(path, split, keep=False))


@pytest.mark.parametrize("split", [64, 1 << 30])
def test_damage_is_a_row_and_reading_goes_on(tmp_path, split):
    good = [member(f"u{i}", bytes([65 + i]) * 300) for i in range(6)]
    broken = bytearray(good[2])
    broken[40:60] = b"\xff" * 20
    path = tmp_path / "a.warc.gz"
    path.write_bytes(good[0] + b"between" + good[1] + bytes(broken) + good[3] + member("short", b"abc", 9) + good[5][:-20])
    rows = in_ranges(path, split)
    assert {r[2] for r in rows if r[2] and not r[7]} >= {"u0", "u1", "u3"}
    problems = [r[7] for r in rows if r[7]]
    assert "bytes after a gzip member" in problems and "payload shorter than its length" in problems
    assert "gzip cut short" in problems and "gzip damaged" in problems
    path.write_bytes(b"\x1f\x8bjunk" + good[0])
    assert [r[7] for r in in_ranges(path, split)] == ["bytes before the first record", None]


def test_source_plans_ranges(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.warc.gz").write_bytes(b"".join(member(f"{n}-{i}", random.Random(i).randbytes(500)) for i in range(20)))
    plain = gzip.decompress((tmp_path / "0.warc.gz").read_bytes())
    (tmp_path / "plain.warc").write_bytes(plain + b"no record at the end")
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    found = archive_files.read(spark, str(tmp_path), split=2000)
    assert found.rdd.getNumPartitions() > 12
    rows = found.collect()
    assert len({(r.path, r.record_no) for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert sorted(r.uri for r in by["1.warc.gz"]) == sorted(f"1-{i}" for i in range(20))
    assert [r.uri for r in sorted(by["plain.warc"], key=lambda r: r.record_no)] == [*(f"0-{i}" for i in range(20)), None]
    assert [r.problem for r in by["empty.warc.gz"]] == ["no record"]


def test_frames_are_bounded_by_bytes_and_rows(spark, monkeypatch):
    """What a Python worker holds depends on neither the rows of a batch nor the length of a file."""
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    monkeypatch.setattr(archives, "BATCH_BYTES", 1000)
    monkeypatch.setattr(archives, "BATCH_ROWS", 7)
    long = [("p", bytes(400)) for _ in range(10)]
    assert [len(f) for f in archives.framed(iter(long), ["path", "content"])] == [3, 3, 3, 1]
    short = [(str(i), None) for i in range(16)]
    frames = list(archives.framed(iter(short), ["path", "content"]))
    assert [len(f) for f in frames] == [7, 7, 2]
    assert [p for f in frames for p in f["path"]] == [p for p, _ in short]
    assert list(archives.framed(iter([]), ["path", "content"])) == []


def test_splits_grow_with_the_archives():
    from murmur.plans import sealed

    assert sealed._split_of(1 << 20) == 1 << 16
    assert 90 <= (1 << 30) // sealed._split_of(1 << 30) <= 110
    assert sealed._split_of(1 << 40) == archive_files.SPLIT_BYTES
