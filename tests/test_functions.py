"""Column functions against Python's own behaviour."""

import hashlib
import json
import re
import uuid
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from murmur.functions import addresses, ids, jsontext, moments, text


def column(spark, values, fn, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in frame.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


TIMES = [
    "2026-08-04T09:12:04", "2026-08-04T09:12:04Z", "2026-08-04T09:12", "2026-08-04T09",
    "2026-08-04", "2026-08-04T09:12:04+00:00", "2026-08-04T09:12:04.5+04:00",
    "2026-08-04T09:12+0400", "2026-08-04 09:12:04-05:30", "20260804T091204", "20260804T0912Z",
    "2026-W32-2T09:12:04", "2026W322", "2026-W32", "2020-W53-5", "2026-W54-1", "2026", "9:12", "",
    "  2026-08-04T09:12:04Z ", "2026-13-04T09:12:04", "2026-02-30", "2026-08-04T24:00:00",
    "2026-08-04T09:60", "nonsense", "2026-08-04T09:12:04.123456789", "2026-08-04T09:12:04,25",
    "2026-08-04T09:12:04+01", "2026-08-04T", "2024-02-29T00:00:00Z", "2023-02-29T00:00:00Z",
    "2026-08-04T09:12:04+02:00:00", "2026-08-04x09:12:04", "2026-08-04T9:12",
]


def python_parse(raw):
    value = raw.strip()
    if not value:
        return None
    try:
        parsed = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return None
    parsed = parsed if parsed.tzinfo else parsed.replace(tzinfo=UTC)
    return parsed.astimezone(UTC).replace(tzinfo=None)


def test_parse_iso_agrees_with_python(spark):
    got = column(spark, TIMES, lambda c: moments.parse_iso(c).cast("timestamp_ntz"))
    assert dict(zip(TIMES, got, strict=True)) == {t: python_parse(t) for t in TIMES}


def test_parse_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tbilisi")
    try:
        got = column(spark, ["2026-08-04T09:12:04"], lambda c: F.unix_micros(moments.parse_iso(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [int(datetime(2026, 8, 4, 9, 12, 4, tzinfo=UTC).timestamp()) * 10**6]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2026-08-04T09:12:04", "second"), ("2026-08-04T09:12:04Z", "second"),
        ("2026-08-04T09:12", "minute"), ("2026-08-04T09:12+00:00", "minute"),
        ("2026-08-04T09", "hour"), ("2026-08-04T09-05:00", "hour"), ("2026-08-04", "day"),
        ("2026-08-04T09:12:04.5", "second"), ("2026-08-04T09:12-03+1", "second"),
        ("2026-08-04T09:12ZZ", "minute"), ("", "second"),
    ],
)
def test_precision(spark, raw, want):
    assert column(spark, [raw], moments.timestamp_precision) == [want]


TEXTS = [
    "  a\tb\n c ", "a  b　", "\x1ca\x1fb\x85c", "", " ", "ხიდის პროექტი",
    "ab ხიდ", "abcd ხიდ", "123 !?", "zero​width", 'quote " back \\ slash / nl \n tab \t',
    "ctrl \x01 \x1f \x0b", "emoji 😀 – dash", "literal \\u000B",
]


def test_whitespace(spark):
    want = [re.sub(r"\s+", " ", t).strip() for t in TEXTS]
    assert column(spark, TEXTS, text.collapse_whitespace) == want


def test_script(spark):
    want = ["latin"] * 3 + [None, None, "georgian", "georgian", "latin", None, "latin"]
    assert column(spark, TEXTS[:10], text.script_of) == want


def test_json_text_is_what_python_writes(spark):
    kept = column(spark, TEXTS, jsontext.string)
    assert kept == [json.dumps(t, ensure_ascii=False) for t in TEXTS]
    escaped = column(spark, TEXTS, lambda c: jsontext.string(c, ascii_only=True))
    assert escaped == [json.dumps(t) for t in TEXTS]


def test_float_text(spark):
    values = [0.0, -0.0, 1.0, 4.0, 41.5, 1e7, 12345678.25, 1e15, 1e16, 1.5e17, 1e-3, 1e-4,
              2.5e-5, 123456789.123, -7.25, 1e22, 0.1, float("inf")]
    assert column(spark, values, text.float_text, "double") == [repr(v) for v in values]


def test_uuid5_and_prefixed_digest(spark):
    names = ["a", "", "ხიდი", "x" * 200]
    got = column(spark, names, lambda c: ids.uuid5(ids.STIX_NAMESPACE, c))
    assert got == [str(uuid.uuid5(uuid.UUID(ids.STIX_NAMESPACE), n)) for n in names]

    def prefixed(*fields):
        data = [f.encode() for f in fields]
        return hashlib.sha256(b"".join(len(d).to_bytes(8, "big") + d for d in data)).hexdigest()

    got = column(spark, names, lambda c: ids.prefixed_digest(c, F.lit("c"), F.concat(c, F.lit("z"))))
    assert got == [prefixed(n, "c", n + "z") for n in names]


def test_prefixes_keep_fields_apart(spark):
    frame = spark.createDataFrame([("ab", "c", "a", "bc")], "a string, b string, c string, d string")
    row = frame.select(
        ids.prefixed_digest(F.col("a"), F.col("b")).alias("x"),
        ids.prefixed_digest(F.col("c"), F.col("d")).alias("y"),
    ).first()
    assert row.x != row.y


def test_digest_check(spark):
    good = "a" * 64
    got = column(spark, [good, good.upper(), good[:-1], good + "\n", None], text.is_digest)
    assert got == [True, False, False, False, False]


def test_hour_of_week(spark):
    times = ["2026-08-03 00:00:00", "2026-08-09 23:59:59"]
    assert column(spark, times, lambda c: moments.hour_of_week(c.cast("timestamp"))) == [0, 167]


def test_iso_offset_text(spark):
    values = [datetime(2026, 8, 4, 9, 12, 4), datetime(2026, 8, 4, 9, 12, 4, 500)]
    got = column(spark, values, moments.iso_offset_text, "timestamp")
    assert got == [v.replace(tzinfo=UTC).isoformat() for v in values]


SOURCES = [
    ("https://t.me/s/kites", "telegram", "https://t.me/s/kites"),
    ("<https://t.me/kites/>", "telegram", "https://t.me/s/kites"),
    ("@kites", "telegram", "https://t.me/s/kites"),
    ("kites?before=3", "telegram", "https://t.me/s/kites"),
    ("bad name", "telegram", None),
    ("http://m.facebook.com/page.one/posts/1", "facebook", "https://www.facebook.com/page.one"),
    ("@page-two", "facebook", "https://www.facebook.com/page-two"),
    ("https://example.org/a/", "html", "https://example.org/a"),
    ("example.org", "html", None),
    ("<>", "html", None),
]


def test_source_lines(spark):
    frame = spark.createDataFrame([s[:2] for s in SOURCES], "line string, platform string")
    n = addresses.normalise_source(F.col("line"), F.col("platform"))
    got = {r.line: (r.url, r.reason) for r in frame.select("line", n["url"], n["reason"]).toDF(
        "line", "url", "reason").collect()}
    for line, _, url in SOURCES:
        assert got[line][0] == url
        assert (got[line][1] is None) == (url is not None)


def test_canonical_document(spark):
    """Against Python's own sorted writing, over odd documents."""
    good = [
        '{"b": 1, "a": [1.0, 1e3, -0.0, 12345678901234567890123, 0.1]}', '{"b":{"z":{"é":1,"e":2},"a":null},"B":true}',
        '[]', ' {"a" :\n"\\u10d0\\/\\t\\u0001\\"" }', '{"a":1,"a":2}', '"x"', "null", '{"\U0001F600":1,"\uffff":2}', "[" * 200 + "]" * 200,
    ]
    bad = [None, "", "{", '{"a":NaN}', "[Infinity]", '["\\ud800"]', "{'a':1}", "[" * 200000 + "]" * 200000, "1 2"]
    got = column(spark, good + bad, jsontext.canonical)
    assert got[len(good):] == [None] * len(bad)
    for text_, made in zip(good, got):
        assert made == json.dumps(json.loads(text_), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert json.loads(made) == json.loads(text_)
    assert got[4] == '{"a":2}' and got[0].startswith('{"a":[1.0,1000.0,-0.0,12345678901234567890123,0.1]')
