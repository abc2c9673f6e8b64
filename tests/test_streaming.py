"""Streams over several micro-batches."""

from datetime import datetime, timedelta

from murmur.operators import burst
from pyspark.sql import functions as F

from murmur.streaming import jobs
from tests.test_burst import BASE, frame, greedy


def run_parts(spark, tmp_path, parts, delay):
    job = jobs.BurstStream(spark, str(tmp_path), burst.BurstRule(window_seconds=60), delay)
    for i, rows in enumerate(parts):
        job.process(frame(spark, rows), i)
    return job


def windows(found):
    secs = lambda ts: (ts - BASE).total_seconds()
    return {(r.project_id, secs(r.window_start), secs(r.window_end), r.item_count,
             r.account_count) for r in found.collect()}


def test_batches_give_the_same_windows(spark, tmp_path):
    rows = [("p", s * 9, f"a{s % 4}") for s in range(400)]
    rows += [("q", s * 200, f"a{s}") for s in range(10)]
    rows.sort(key=lambda r: r[1])
    parts = [rows[:150], rows[150:155], rows[155:]]
    job = run_parts(spark, tmp_path, parts, 30)
    early = windows(job.findings())
    job.flush()
    full = greedy(rows, 60, 4, 3)
    assert early < windows(job.findings()) == full
    assert job.late_rows().first().late == 0


def test_late_rows_are_counted_and_dropped(spark, tmp_path):
    first = [("p", s, f"a{s}") for s in (0, 10, 20, 30, 1000)]
    job = run_parts(spark, tmp_path, [first, [("p", 15, "zz"), ("p", 1010, "b")]], 100)
    job.flush()
    assert job.late_rows().first().late == 1
    assert windows(job.findings()) == {("p", 0, 30, 4, 4)}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    parts = [[("p", s, f"a{s}") for s in (0, 10, 20, 30)], [("p", s, f"a{s}") for s in (500, 900)]]
    job = run_parts(spark, tmp_path, parts, 10)
    before = windows(job.findings())
    job.process(frame(spark, parts[1]), 1)
    assert windows(job.findings()) == before


def test_findings_take_the_counts_of_their_starts(spark):
    rows = [("p", s * 9, f"a{s % 4}") for s in range(400)] + [("q", s, None) for s in (0, 5, 5, 9)]
    rows += [("q", 7, "x"), ("q", 8, "y"), ("q", 8, "y"), (None, 8, "z")]
    obs, rules = frame(spark, rows), [burst.BurstRule(window_seconds=60)]
    starts = burst.burst_starts(obs, rules).localCheckpoint()
    found = burst.findings_of_starts(obs, starts, rules)
    plain = burst.findings(burst.members(obs, starts, rules), rules)
    assert found.columns == plain.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    assert windows(found) >= {("q", 0, 9, 8 - 1, 3)}
    # no item is dealt by its account
    exchanged = [
        line for line in found._jdf.queryExecution().sparkPlan().toString().split("\n")
        if "Aggregate(" in line and "account_id" in line
    ]
    assert not exchanged


def test_a_batch_is_read_once(spark, tmp_path):
    job = jobs.BurstStream(spark, str(tmp_path), burst.BurstRule(window_seconds=60), 10)
    job.process(frame(spark, []), 0)
    read = spark.sparkContext.accumulator(0)

    def passes(value):
        read.add(1)
        return value

    rows = frame(spark, [("p", s, f"a{s}") for s in (0, 10, 20, 30)])
    counted = F.udf(passes, "long").asNondeterministic()(F.unix_micros("posted_at"))
    counting = rows.withColumn("posted_at", F.timestamp_micros(counted))
    job.process(counting, 1)
    assert read.value == 4
    job.process(frame(spark, [("p", 15, "late")]), 2)
    job.process(frame(spark, []), 3)
    job.flush()
    assert job.late_rows().first().late == 1 and job.late_items().count() == 1
    assert windows(job.findings()) == {("p", 0, 30, 4, 4)}


def test_content_log(spark, tmp_path):
    log = jobs.ContentLog(spark, str(tmp_path))
    day = datetime(2026, 8, 4)

    def batch(*rows):
        return spark.createDataFrame(
            [("c", day, "t", cap, tr, day + timedelta(hours=h), seq) for cap, tr, h, seq in rows],
            "content_id string, posted_at timestamp, tenant_id string, capture_id string, "
            "trace_id string, seen_at timestamp, seq long",
        )

    log.process(batch(("k1", "t1", 5, 1), ("k2", "t2", 1, 2)), 0)
    log.process(batch(("k3", "t3", 0, 1)), 1)
    log.process(batch(("k3", "t3", 0, 1)), 1)
    row = log.current().first()
    assert (row.capture_id, row.trace_id) == ("k1", "t1")
    assert (row.last_capture_id, row.last_trace_id) == ("k3", "t3")
    assert row.last_seen == day

    log.process(batch(("k4", "t4", 2, 1)).withColumn("tenant_id", F.lit("other")), 2)
    before = sorted(map(tuple, log.current().collect()))
    assert len(before) == 2
    for through in (0, 1, 2):
        small = log.compact(f"{tmp_path}/compact{through}", through)
        assert sorted(map(tuple, small.current().collect())) == before
        small.process(batch(("k9", "t9", 7, 1)), 9)
        assert {r.last_capture_id for r in small.current().collect()} == {"k9", "k4"}


def test_health_merges_in_order_of_arrival(spark, tmp_path):
    job = jobs.HealthStream(spark, str(tmp_path))

    def batch(*rows):
        return spark.createDataFrame(
            [(s, i, BASE + timedelta(seconds=i), st, f"r{i}" if st != "succeeded" else None)
             for s, i, st in rows],
            "source_id string, job_id long, started_at timestamp, status string, "
            "failure_reason string",
        )

    job.process(batch(("a", 1, "succeeded"), ("a", 2, "failed"), ("b", 3, "failed")), 0)
    job.process(batch(("a", 4, "failed"), ("b", 5, "succeeded"), ("c", 6, "failed")), 1)
    rows = {r.source_id: r for r in job.current().collect()}
    assert (rows["a"].consecutive_failures, rows["a"].last_failure_reason) == (2, "r4")
    assert (rows["b"].consecutive_failures, rows["b"].last_failure_reason) == (0, None)
    assert rows["c"].consecutive_failures == 1
