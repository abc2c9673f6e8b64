"""Weekly profile and readiness: truth tables."""

import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from murmur.operators import baseline, collect

MONDAY = datetime(2026, 8, 3)


def profile_and_z(spark, values, hour, items):
    counts = spark.createDataFrame(
        [("s", MONDAY + timedelta(weeks=w, hours=9), v) for w, v in enumerate(values)],
        "source_id string, hour timestamp, items long",
    )
    asked = spark.createDataFrame(
        [("s", hour, items)], "source_id string, hour timestamp, items long"
    )
    return baseline.z_scores(asked, baseline.volume_profile(counts)).first()


def test_z_truth_table(spark):
    nine = MONDAY + timedelta(weeks=9, hours=9)
    assert profile_and_z(spark, [10, 12, 11, 9], MONDAY + timedelta(days=6, hours=4), 40).z is None
    assert profile_and_z(spark, [10, 12], nine, 500).z is None
    assert profile_and_z(spark, [10, 10, 10], nine, 10).z == 0.0
    busy = [40, 42, 38, 41, 39]
    row = profile_and_z(spark, busy, nine, 41)
    assert abs(row.z) < 1
    assert abs(row.stdev - statistics.pstdev(busy)) < 1e-12
    assert profile_and_z(spark, [1, 0, 2, 1, 1], nine, 40).z > 3
    assert profile_and_z(spark, [5, 5, 5, 5], nine, 50).z == 3.0
    assert profile_and_z(spark, [5, 5, 5, 5], nine, 1).z == -3.0
    assert profile_and_z(spark, [40, 42, 38, 41], nine, 0).z < -3
    assert profile_and_z(spark, [0, 0, 6, 0, 0], nine, 0).mean < 2


def test_silence_counts_as_zero(spark):
    obs = spark.createDataFrame(
        [("s", MONDAY), ("s", MONDAY + timedelta(hours=3, minutes=5)), ("q", MONDAY)],
        "source_id string, posted_at timestamp",
    )
    rows = baseline.hourly_counts(obs).orderBy("source_id", "hour").collect()
    assert [(r.source_id, r["items"]) for r in rows] == [
        ("q", 1), ("s", 1), ("s", 0), ("s", 0), ("s", 1),
    ]


def test_profile_of_a_span_equals_that_of_the_filled_hours(spark):
    """Also with items of other centuries; nothing is cut or expanded."""
    rows = [("s", MONDAY + timedelta(hours=h)) for h in (0, 0, 0, 3, 9, 168, 177, 400, 400)]
    rows += [("one", MONDAY), ("old", datetime(1999, 12, 31, 23, 59)), ("old", datetime(2001, 2, 3)), ("none", None)]
    obs = spark.createDataFrame(rows, "source_id string, posted_at timestamp")
    busy = baseline.busy_hours(obs)
    want = {(r.source_id, r.hour_of_week): r for r in baseline.volume_profile(baseline.hourly_counts(obs)).collect()}
    got = {(r.source_id, r.hour_of_week): r for r in baseline.span_profile(busy).collect()}
    assert got.keys() == want.keys() and {k[0] for k in got} == {"s", "one", "old"}
    for k, r in got.items():
        assert r.samples == want[k].samples and abs(r.mean - want[k]["mean"]) < 1e-12 and abs(r.stdev - want[k].stdev) < 1e-12
    wide = spark.createDataFrame([("w", datetime(1, 1, 2)), ("w", datetime(9999, 1, 1))], "source_id string, posted_at timestamp")
    assert baseline.span_profile(baseline.busy_hours(wide)).agg(F.sum("samples")).first()[0] > 87_000_000
    asked = spark.createDataFrame([("s", MONDAY + timedelta(hours=h)) for h in (0, 5, 999)], "source_id string, hour timestamp")
    assert sorted(r["items"] for r in baseline.scores_at(asked, busy).collect()) == [0, 3]


NOW = datetime(2026, 9, 1)
CASES = {
    "never": (0, 0, None, "collecting"),
    "young": (27, 27, NOW, "collecting"),
    "scattered": (28, 100, NOW, "collecting"),
    "good": (28, 30, NOW - timedelta(days=1), "ready"),
    "edge of coverage": (28, 35, NOW, "ready"),
    "long silent": (90, 90, NOW - timedelta(days=60), "stale"),
    "six days": (30, 30, NOW - timedelta(days=6), "ready"),
    "seven days exactly": (30, 30, NOW - timedelta(days=7), "ready"),
    "eight days": (30, 30, NOW - timedelta(days=8), "stale"),
    "young and silent": (10, 10, NOW - timedelta(days=30), "collecting"),
}


def test_readiness_states(spark):
    frame = spark.createDataFrame(
        [(k, *v[:3]) for k, v in CASES.items()],
        "k string, observed_days long, window_days long, last_collected_at timestamp",
    )
    rows = baseline.readiness(frame, F.lit(NOW)).collect()
    assert {r.k: r.status for r in rows} == {k: v[3] for k, v in CASES.items()}
    assert all(r.may_fire == (r.status == "ready") and r.reason for r in rows)


def test_observation_window_counts_days_with_success_only(spark):
    jobs = spark.createDataFrame(
        [("p", MONDAY, "succeeded"), ("p", MONDAY + timedelta(hours=5), "succeeded"),
         ("p", MONDAY + timedelta(days=4), "succeeded"),
         ("p", MONDAY + timedelta(days=9), "failed_network"),
         ("q", MONDAY, "failed_network")],
        "project_id string, started_at timestamp, status string",
    )
    rows = collect.observation_window(jobs, ["project_id"]).collect()
    assert [(r.project_id, r.observed_days, r.window_days) for r in rows] == [("p", 2, 5)]


def test_health_resets_on_success(spark):
    t = [MONDAY + timedelta(hours=i) for i in range(6)]
    jobs = spark.createDataFrame(
        [("a", 1, t[0], "failed_network", "x"), ("a", 2, t[1], "succeeded", None),
         ("a", 3, t[2], "failed_network", "y"), ("a", 4, t[3], "failed_timeout", "z"),
         ("b", 5, t[4], "succeeded", None), ("c", 6, t[5], "failed_network", "w"),
         ("c", 7, t[5], "running", None)],
        "source_id string, job_id long, started_at timestamp, status string, "
        "failure_reason string",
    )
    rows = {r.source_id: r for r in collect.source_health(jobs).collect()}
    assert (rows["a"].consecutive_failures, rows["a"].last_failure_reason) == (2, "z")
    assert (rows["b"].consecutive_failures, rows["b"].last_failure_reason) == (0, None)
    assert (rows["c"].consecutive_failures, rows["c"].last_success_at) == (1, None)


def test_run_summary(spark):
    stages = spark.createDataFrame(
        [("idle", 0, "schedule", "ok", "", 0, None), ("ok", 0, "schedule", "ok", "", 2, None),
         ("ok", 1, "evidence", "ok", "", None, None), ("ok", 2, "extract", "ok", "", None, 7),
         ("bad", 0, "schedule", "ok", "", 1, None), ("bad", 1, "fetch", "failed", "late", None, None),
         ("bad", 2, "detect", "failed", "later", None, None)],
        "run_id string, stage_no long, stage string, status string, detail string, due long, "
        "items long",
    )
    none = F.lit(None).cast("long")
    full = stages.withColumns({"findings": none, "exports": none, "held_for_review": none})
    rows = {r.run_id: r for r in collect.run_summary(full).collect()}
    assert {k: r.outcome for k, r in rows.items()} == {"idle": "idle", "ok": "ok", "bad": "failed"}
    assert rows["bad"].detail == "fetch: late"
    assert (rows["ok"].captures, rows["ok"]["items"], rows["ok"].sources_due) == (1, 7, 2)
