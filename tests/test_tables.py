"""Accessors, invariants and source lists."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from murmur.operators import collect, content, quality
from murmur.sources import tables


def test_no_tenant_means_no_rows(spark):
    frame = spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, v int")
    assert tables.for_tenant(frame, None).count() == 0
    assert [r.v for r in tables.for_tenant(frame, "t2").collect()] == [2]
    with pytest.raises(ValueError, match="project"):
        tables.for_project(frame, "")


def test_months_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "content")
    schema = "content_id string, posted_at timestamp"
    tables.write_by_month(spark.createDataFrame(
        [("a", datetime(2024, 1, 5)), ("b", datetime(2024, 2, 5))], schema), path)
    tables.write_by_month(spark.createDataFrame([("c", datetime(2024, 2, 6))], schema), path)
    got = {r.content_id for r in spark.read.parquet(path).collect()}
    assert got == {"a", "c"}


def test_out_of_range(spark):
    frame = spark.createDataFrame(
        [(datetime(2023, 12, 31, 23),), (datetime(2024, 1, 1),), (datetime(2028, 1, 1),)],
        "posted_at timestamp",
    )
    row = tables.out_of_range(frame).first()
    assert (row.outside, row.total) == (2, 3)


def test_grant_rules(spark):
    at = datetime(2026, 1, 1)
    frame = spark.createDataFrame(
        [("good", "u1", "u2", ["read"], "a long enough justification", at, datetime(2026, 1, 1, 12)),
         ("long", "u1", "u2", ["read"], "a long enough justification", at,
          datetime(2026, 1, 1, 12, 0, 1)),
         ("self", "u1", "u1", [], "short", at, at)],
        "id string, granted_to string, granted_by string, permissions array<string>, "
        "justification string, created_at timestamp, expires_at timestamp",
    )
    got = {r.id: set(r.violated) for r in quality.violations(frame, "grants", ["id"]).collect()}
    assert got == {"long": {"short"},
                   "self": {"expires_later", "justified", "grants_something", "not_self"}}


def test_every_rule_parses(spark):
    for table in quality.RULES:
        for rule in quality.rules_for(table).values():
            assert F.expr(rule) is not None


def test_pasted_list(spark):
    pasted = spark.createDataFrame(
        [("t", "telegram", 1, "# note\n@one, https://t.me/s/one\n\nbad name\ntwo\r\nthree")],
        "tenant_id string, platform string, list_id int, pasted string",
    )
    lines = collect.source_lines(pasted).withColumn("seq", F.struct("list_id", "line_no"))
    existing = spark.createDataFrame(
        [("t", "https://t.me/s/two", "older")], "tenant_id string, url string, source_id string"
    )
    rows = collect.ingest_sources(lines, existing).orderBy("seq").collect()
    assert [(r.line, r.outcome) for r in rows] == [
        ("@one", "added"), ("https://t.me/s/one", "duplicate"), ("bad name", "rejected"),
        ("two", "duplicate"), ("three", "added"),
    ]


def test_merge_keeps_provenance(spark):
    day = datetime(2026, 8, 4)
    schema = ("content_id string, posted_at timestamp, tenant_id string, capture_id string, "
              "trace_id string, seen_at timestamp, seq long")
    one = spark.createDataFrame([("c", day, "t", "k1", "t1", day, 5)], schema)
    two = spark.createDataFrame([("c", day, "t", "k2", "t2", datetime(2026, 8, 1), 1)], schema)
    row = content.merge_content(content.merge_content(None, one), two).first()
    assert (row.capture_id, row.last_capture_id) == ("k1", "k2")
    assert (row.first_seen, row.last_seen) == (day, datetime(2026, 8, 1))


def test_tenants_share_nothing(spark):
    day = datetime(2026, 8, 4)
    seen = spark.createDataFrame(
        [("a", t, "html", "h", name, day, 1) for t, name in (("t1", "one"), ("t2", "two"))],
        "account_id string, tenant_id string, platform string, handle string, display_name string, "
        "seen_at timestamp, seq long",
    )
    both = content.merge_accounts(content.merge_accounts(None, seen), seen)
    assert {(r.tenant_id, r.display_name) for r in both.collect()} == {("t1", "one"), ("t2", "two")}


def test_an_item_listed_twice_is_updated_once(spark):
    day = datetime(2026, 8, 4)
    shape = ("tenant_id string, {capture} string, content_id string, posted_at timestamp, text string, "
             "text_sha256 string, script string, timestamp_precision string, extractor_version int")
    stored = spark.createDataFrame(
        [("t", "c", "i", day, "old", "o", None, "second", 1)], shape.format(capture="last_capture_id")
    ).selectExpr("*", "cast(null as timestamp) as deleted_at")
    parsed = spark.createDataFrame(
        [("t", "c", "i", day, text, text, None, "minute", 2, n) for n, text in enumerate(("first", "second"))],
        shape.format(capture="capture_id") + ", ordinal int",
    )
    outcomes = content.reprocess_outcomes(stored, parsed)
    assert [r.outcome for r in outcomes.orderBy("ordinal").collect()] == ["updated", "unchanged"]
    new = content.apply_reprocessing(stored, outcomes).collect()
    assert [(r.text, r.extractor_version) for r in new] == [("first", 2)]
