"""Streaming queries: the events table replayed as a file stream in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions.moments import micros
from murmur.operators import baseline, burst, chain
from murmur.plans import sample
from murmur.plans.detection import _HOURLY, WINDOWS_SQL, _windows
from murmur.plans.reads import _AUDIT, _audit_rows
from murmur.plans.registry import plain, query, table
from murmur.plans.sample import BY_USER_GROUP, JOBS_SQL, bursts_sql
from murmur.session import work_dir
from murmur.streaming import jobs, stateful, windows
from murmur.streaming.chains import ChainStream

CHUNKS = 3


def _replay(spark, sf, build, drive, doubled: bool = False, closing: bool = False,
            order: str = "posted_at"):
    """Deliver all events in a few parts; ``drive`` consumes each as it lands.

    Parts are ranges of time, so that no row is late however the ids lie, or of ``event_id``
    where that is the order of arrival. ``closing`` sends a row of nobody two days later, so
    that the watermark passes all rows.
    """
    landing = work_dir(spark, "landing")
    rows = build(table(spark, sf, "events"))
    place = micros(F.col(order)) if order == "posted_at" else F.col(order)
    first, top = rows.agg(F.coalesce(F.min(place), F.lit(0)), F.coalesce(F.max(place) + 1, F.lit(1))).first()
    if order == "posted_at":
        # rows without a time come first
        place = F.coalesce(place, F.lit(first))
    for part in range(CHUNKS):
        lo, hi = [first + (top - first) * k // CHUNKS for k in (part, part + 1)]
        chunk = rows.where((place >= lo) & (place < hi))
        if doubled:
            chunk = chunk.unionByName(chunk.where(F.col("event_id") % 10 == 0))
        chunk.drop("event_id").write.parquet(f"{landing}/part={part}")
        schema = spark.read.parquet(f"{landing}/part={part}").schema
        drive(spark.readStream.schema(schema).parquet(f"{landing}/part=*"))
    if closing:
        later = F.max("posted_at") + F.expr("INTERVAL 2 DAYS")
        last = spark.read.parquet(f"{landing}/part={CHUNKS - 1}").agg(later.alias("posted_at"))
        nobody = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != "posted_at"]
        last.select("posted_at", *nobody).write.parquet(f"{landing}/part={CHUNKS}")
        drive(spark.readStream.schema(schema).parquet(f"{landing}/part=*"))


def _observed(events, project=None):
    ts = F.col("ts").cast("timestamp")
    return events.select(
        "event_id",
        F.lit("t0").alias("tenant_id"),
        (F.lit("all") if project is None else project).alias("project_id"),
        F.col("event_type").alias("source_id"),
        F.col("event_id").cast("string").alias("content_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("account_id"),
        F.lit("c").alias("capture_id"),
        F.lit("c").alias("last_capture_id"),
        ts.alias("posted_at"),
        F.lit("second").alias("timestamp_precision"),
    )


@query("stream_bursts", bursts_sql() + WINDOWS_SQL)
def stream_bursts(spark, sf):
    """Burst windows found micro-batch by micro-batch; the same as in one pass."""
    path = work_dir(spark, "bursts")
    job = jobs.BurstStream(spark, path, burst.BurstRule(), delay_seconds=7200)
    checkpoint = f"{path}/checkpoint"
    _replay(spark, sf, _observed, lambda stream: jobs.run(stream, job.process, checkpoint))
    job.flush()
    return _windows(job.findings())


@query("stream_bursts_stateful", bursts_sql(BY_USER_GROUP, 3600, 4, 3) + WINDOWS_SQL)
def stream_bursts_stateful(spark, sf):
    """Burst windows of an hour from rows held in the state store; the same as in one pass."""
    path = work_dir(spark, "bursts-state")
    rule = burst.BurstRule("hour", "hour windows", 3600, 4, 3)

    def observed(events):
        return _observed(events, sample.by_user_group())

    def drive(stream):
        found = stateful.burst_windows(stream, rule, "10 minutes")
        stateful.with_state_store(
            spark, lambda: jobs.run_to_files(found, f"{path}/out", f"{path}/checkpoint")
        )

    _replay(spark, sf, observed, drive, closing=True)
    return _windows(spark.read.parquet(f"{path}/out"))


@query(
    "stream_sliding",
    """WITH w AS (SELECT unnest([epoch_us(ts) // 120000000 * 120000000, epoch_us(ts) // 120000000 *
 120000000 - 120000000]) AS s FROM events) SELECT make_timestamp(s) AS window_start,
 count(*) AS items FROM w GROUP BY s HAVING count(*) >= 4 AND s + 240000000 <=
 (SELECT epoch_ms(max(ts)) * 1000 - 600000000 FROM events)""",
)
def stream_sliding(spark, sf):
    """Closed sliding windows in which a burst of one account or more is possible."""
    path = work_dir(spark, "sliding")
    rule = burst.BurstRule(minimum_accounts=1)

    def drive(stream):
        found = windows.busy_windows(stream, rule, "10 minutes")
        jobs.run_to_files(found, f"{path}/out", f"{path}/checkpoint")

    _replay(spark, sf, _observed, drive)
    out = spark.read.parquet(f"{path}/out")
    return out.select(plain("window_start").alias("window_start"), "items")


@query(
    "stream_sliding_accounts",
    """WITH w AS (SELECT unnest([epoch_us(ts) // 3600000000 * 3600000000, epoch_us(ts) // 3600000000 *
 3600000000 - 3600000000]) AS s, user_id FROM events) SELECT make_timestamp(s) AS window_start,
 count(*) AS items FROM w GROUP BY s HAVING count(*) >= 4 AND count(DISTINCT user_id) >= 0.7 * 36
 AND s + 7200000000 <= (SELECT epoch_ms(max(ts)) * 1000 - 600000000 FROM events)""",
)
def stream_sliding_accounts(spark, sf):
    """Closed windows of two hours in which a burst of 36 accounts is possible, by sketches of panes."""
    path = work_dir(spark, "sliding-accounts")
    rule = burst.BurstRule(window_seconds=3600, minimum_accounts=36)

    def drive(stream):
        found = windows.busy_windows(stream, rule, "10 minutes")
        jobs.run_to_files(found, f"{path}/out", f"{path}/checkpoint")

    _replay(spark, sf, _observed, drive)
    out = spark.read.parquet(f"{path}/out")
    return out.select(plain("window_start").alias("window_start"), "items")


@query(
    "stream_hourly_z",
    _HOURLY
    + """ SELECT h.source_id, h.hour, h.items, round(CASE WHEN p.samples >= 3 THEN
 CASE WHEN p.stdev = 0 THEN CASE WHEN h.items = p.mean THEN 0.0 WHEN h.items > p.mean THEN 3.0
 ELSE -3.0 END ELSE (h.items - p.mean) / p.stdev END END, 9) AS z
 FROM h JOIN p ON p.source_id = h.source_id AND p.how = h.how WHERE h.items > 0 AND
 epoch_us(h.hour) + 3600000000 <= (SELECT epoch_ms(max(ts)) * 1000 - 600000000 FROM events)""",
)
def stream_hourly_z(spark, sf):
    """Closed hours scored against the stored profile."""
    path = work_dir(spark, "hourly")
    profile = baseline.span_profile(baseline.busy_hours(sample.observations(spark, sf)))

    def drive(stream):
        scored = windows.hourly_z(stream, profile, "10 minutes")
        jobs.run_to_files(scored, f"{path}/out", f"{path}/checkpoint")

    _replay(spark, sf, _observed, drive)
    out = spark.read.parquet(f"{path}/out")
    return out.select(
        "source_id", plain("hour").alias("hour"), "items", F.round("z", 9).alias("z")
    )


@query(
    "stream_dedupe",
    "SELECT event_type AS source_id, count(*) AS items FROM events GROUP BY 1",
)
def stream_dedupe(spark, sf):
    """Items delivered twice are let through once."""
    path = work_dir(spark, "dedupe")

    def drive(stream):
        jobs.run_to_files(
            windows.first_sightings(stream, "2 hours"), f"{path}/out", f"{path}/checkpoint"
        )

    _replay(spark, sf, _observed, drive, doubled=True)
    return spark.read.parquet(f"{path}/out").groupBy("source_id").agg(
        F.count("*").alias("items")
    )


@query(
    "stream_upsert",
    """WITH e AS (SELECT user_id||'/'||strftime(ts,'%d') AS content_id, 't'||(event_id % 3) AS tenant_id,
 date_trunc('day', ts) AS posted_at, event_type AS capture_id, 'tr'||event_id AS trace_id, ts, event_id
 FROM events) SELECT tenant_id, content_id, posted_at, arg_min(capture_id, event_id) AS capture_id,
 arg_max(capture_id, event_id) AS last_capture_id, arg_max(trace_id, event_id) AS last_trace_id,
 min(ts) AS first_seen, max(ts) AS last_seen FROM e GROUP BY 1, 2, 3""",
)
def stream_upsert(spark, sf):
    """Re-observation as a stream: first columns stay, last columns follow."""
    ts = F.col("ts").cast("timestamp")

    def sighted(events):
        return events.select(
            "event_id",
            F.concat_ws("/", F.col("user_id").cast("string"), F.date_format(ts, "dd")).alias(
                "content_id"
            ),
            F.date_trunc("day", ts).alias("posted_at"),
            F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("tenant_id"),
            F.col("event_type").alias("capture_id"),
            F.concat(F.lit("tr"), F.col("event_id").cast("string")).alias("trace_id"),
            ts.alias("seen_at"),
            F.col("event_id").alias("seq"),
        )

    path = work_dir(spark, "content")
    log = jobs.ContentLog(spark, path)
    checkpoint = f"{path}/checkpoint"
    _replay(spark, sf, sighted, lambda stream: jobs.run(stream, log.process, checkpoint),
            order="event_id")
    return log.current().select(
        "tenant_id", "content_id", plain("posted_at").alias("posted_at"), "capture_id", "last_capture_id",
        "last_trace_id", plain("first_seen").alias("first_seen"),
        plain("last_seen").alias("last_seen"),
    )


@query(
    "stream_source_health",
    f"""WITH j AS ({JOBS_SQL}), l AS (SELECT source_id, max(CASE WHEN status = 'succeeded'
 THEN job_id END) AS ok FROM j GROUP BY 1) SELECT j.source_id, max(started_at) AS last_attempt_at,
 max(CASE WHEN status = 'succeeded' THEN started_at END) AS last_success_at,
 count(*) FILTER (WHERE status <> 'succeeded' AND (ok IS NULL OR job_id > ok))
 AS consecutive_failures, arg_max(failure_reason, job_id) FILTER (WHERE status <> 'succeeded' AND
 (ok IS NULL OR job_id > ok)) AS last_failure_reason FROM j JOIN l ON l.source_id = j.source_id
 GROUP BY j.source_id""",
)
def stream_source_health(spark, sf):
    """Health kept up to date per micro-batch."""

    def attempts(events):
        del events
        return sample.jobs(spark, sf).withColumn("event_id", F.col("job_id"))

    path = work_dir(spark, "health")
    job = jobs.HealthStream(spark, path)
    checkpoint = f"{path}/checkpoint"
    _replay(spark, sf, attempts, lambda stream: jobs.run(stream, job.process, checkpoint),
            order="event_id")
    return job.current().withColumns(
        {
            "last_attempt_at": plain("last_attempt_at"),
            "last_success_at": plain("last_success_at"),
        }
    )


@query(
    "stream_audit_chain",
    _AUDIT + " SELECT tenant_id, CAST(i AS BIGINT) AS chain_index, entry_id, entry_hash FROM c",
)
def stream_audit_chain(spark, sf):
    """The audit chain linked batch by batch, with the last batch delivered again; the same as in one pass."""
    path = work_dir(spark, "audit-chain")
    rows = chain.with_occurred_text(_audit_rows(spark, sf))
    job = ChainStream(spark, path, chain.AUDIT, ["conv_id", "turn"])
    # of each tenant the earlier conversations first
    place = F.pmod("conv_id", F.lit(64))
    for n in range(CHUNKS):
        chunk = rows.where((place >= 64 * n // CHUNKS) & (place < 64 * (n + 1) // CHUNKS))
        chunk.write.parquet(f"{path}/landing/part={n}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/landing/part=*")
        jobs.run(stream, job.process, f"{path}/checkpoint")
    job.process(chunk, job.store.state().applied["chain"])
    return job.entries().select("tenant_id", "chain_index", "entry_id", "entry_hash")
