import pytest

from murmur.session import work_dir
from murmur.sources import scoped


@pytest.fixture
def views(spark):
    content = work_dir(spark, "scoped-content")
    spark.sql(
        """SELECT 't' || id % 3 AS tenant_id, 's' AS source_id, id AS content_id, 'a' AS account_id, 'c' AS capture_id,
 'c' AS last_capture_id, timestamp'2026-01-01' AS posted_at, 'second' AS timestamp_precision, 'x' AS text,
 'r' AS trace_id, 'r' AS last_trace_id, '1' AS extractor_version,
 IF(id % 2 = 0, timestamp'2026-01-02', NULL) AS deleted_at FROM range(12)"""
    ).write.parquet(content)
    users = work_dir(spark, "scoped-users")
    spark.sql(
        "SELECT id AS user_id, IF(id = 5, NULL, 't1') AS tenant_id, 'e' AS email, 'secret' AS password, "
        "IF(id = 1, current_timestamp(), NULL) AS disabled_at FROM range(6)"
    ).write.parquet(users)
    made = scoped.publish(spark, {"content": scoped.files(content), "users": scoped.files(users)})
    assert made == ["content_for_detection", "content_provenance", "active_users"]
    yield
    scoped.set_tenant(spark, None)


def test_rows_follow_the_tenant(spark, views):
    ids = lambda view, key: sorted(r[0] for r in spark.sql(f"SELECT {key} FROM {view}").collect())
    assert ids("content_for_detection", "content_id") == [] == ids("active_users", "user_id")
    scoped.set_tenant(spark, "t1")
    assert ids("content_for_detection", "content_id") == [1, 7]
    assert ids("content_provenance", "content_id") == [1, 4, 7, 10]
    assert ids("active_users", "user_id") == [0, 2, 3, 4]
    before = spark.table("content_provenance")
    scoped.set_tenant(spark, "t2' OR '1'='1")
    assert ids("content_provenance", "content_id") == []
    scoped.set_tenant(spark, None)
    assert ids("content_provenance", "content_id") == []
    # what was planned before keeps its tenant
    assert before.count() == 4


def test_columns_and_pushed_tenant(spark, views, capsys):
    scoped.set_tenant(spark, "t1")
    frame = spark.table("content_for_detection")
    assert "text" not in frame.columns and "password" not in spark.table("active_users").columns
    frame.select("content_id").explain("formatted")
    assert "EqualTo(tenant_id,t1)" in capsys.readouterr().out


def test_publishing_again_keeps_the_tenant(spark, views):
    scoped.set_tenant(spark, "t1")
    assert scoped.publish(spark, {}) == []
    assert spark.table("content_provenance").count() == 4


def test_paths_cannot_break_out():
    with pytest.raises(ValueError):
        scoped.files("a`b")
