"""Detection, baseline and collection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import ids, moments
from murmur.operators import baseline, burst, collect, content, review
from murmur.plans import sample
from murmur.plans.registry import plain, query, table, uuid5_sql
from murmur.plans.sample import (
    ALL,
    BUNDLES_SQL,
    BY_USER_GROUP,
    JOB_SOURCES_SQL,
    JOBS_SQL,
    NOW_SQL,
    OBS_SQL,
    bursts_sql,
)
from murmur.session import materialise

DEFAULT = [burst.BurstRule()]
WIDE = [burst.BurstRule("wide", "wide windows", 3600, 20, 10)]
FINDING_ID = uuid5_sql(
    ids.CONTENT_NAMESPACE, "'finding|t0|'||project_id||'|burst|'||s"
)


def _windows(found):
    return found.select(
        "project_id",
        plain("window_start").alias("window_start"),
        plain("window_end").alias("window_end"),
        "item_count",
        "account_count",
    )


WINDOWS_SQL = """SELECT project_id, make_timestamp(t) AS window_start,
 make_timestamp(e) AS window_end, n AS item_count, a AS account_count FROM win"""


@query("burst_windows", bursts_sql() + WINDOWS_SQL)
def burst_windows(spark, sf):
    """The flagship: every burst over the whole table as one project."""
    return _windows(burst.detect(sample.observations(spark, sf), DEFAULT))


@query("burst_windows_wide", bursts_sql(ALL, 3600, 20, 10) + WINDOWS_SQL)
def burst_windows_wide(spark, sf):
    return _windows(burst.detect(sample.observations(spark, sf), WIDE))


@query("burst_cross_source", bursts_sql(BY_USER_GROUP, 3600, 4, 3) + WINDOWS_SQL)
def burst_cross_source(spark, sf):
    """One search per project over all its sources."""
    rules = [burst.BurstRule("hour", "hour windows", 3600, 4, 3)]
    return _windows(burst.detect(sample.observations(spark, sf, sample.by_user_group()), rules))


@query(
    "burst_rules_registry",
    f"SELECT * FROM (SELECT 'burst' AS rule_id, * FROM ({bursts_sql()} {WINDOWS_SQL})) "
    f"UNION ALL SELECT * FROM (SELECT 'wide' AS rule_id, * FROM "
    f"({bursts_sql(ALL, 3600, 20, 10)} {WINDOWS_SQL}))",
)
def burst_rules_registry(spark, sf):
    """Two rules as data, evaluated in one pass."""
    rules = [*DEFAULT, *WIDE]
    found = burst.detect(sample.observations(spark, sf), rules)
    return found.select(
        "rule_id", "project_id", plain("window_start").alias("window_start"),
        plain("window_end").alias("window_end"), "item_count", "account_count",
    )


def _inside(spark, sf, project=None):
    obs = sample.observations(spark, sf, project)
    return burst.members(obs, burst.burst_starts(obs, DEFAULT), DEFAULT)


@query(
    "burst_signals",
    bursts_sql()
    + f""", f AS (SELECT project_id, t AS s, n, a, e FROM win)
SELECT {FINDING_ID} AS finding_id, g.name, g.observed, g.threshold, g.passed FROM f,
 LATERAL (VALUES ('item_count', CAST(n AS DOUBLE), 4.0::DOUBLE, n >= 4),
 ('distinct_accounts', CAST(a AS DOUBLE), 3.0::DOUBLE, a >= 3),
 ('window_span_seconds', (e - f.s) / 1000000.0::DOUBLE, 120.0::DOUBLE, e - f.s <= 120000000))
 AS g(name, observed, threshold, passed)""",
)
def burst_signals(spark, sf):
    """The three measurements of every finding."""
    found = burst.detect(sample.observations(spark, sf), DEFAULT)
    return found.select("finding_id", F.inline("signals")).drop("description")


@query(
    "burst_members",
    bursts_sql()
    + f"""SELECT {FINDING_ID} AS finding_id, content_id, account_id, capture_id FROM inside""",
)
def burst_members(spark, sf):
    return _inside(spark, sf).select(
        burst.finding_id().alias("finding_id"), "content_id", "account_id", "capture_id"
    )


@query(
    "finding_accounts",
    bursts_sql()
    + f"""SELECT {FINDING_ID} AS finding_id, account_id, count(*) AS item_count
 FROM inside GROUP BY project_id, s, account_id""",
)
def finding_accounts(spark, sf):
    return burst.finding_accounts(_inside(spark, sf)).drop("tenant_id")


@query(
    "finding_captures",
    bursts_sql()
    + f"""SELECT {FINDING_ID} AS finding_id, capture_id, count(*) AS item_count
 FROM inside GROUP BY project_id, s, capture_id""",
)
def finding_captures(spark, sf):
    return burst.finding_captures(_inside(spark, sf)).drop("tenant_id")


_PRECISION_SQL = """CASE WHEN user_id % 8 = 1 THEN 'minute' WHEN user_id % 8 = 2 THEN 'hour'
 WHEN user_id % 8 = 3 THEN 'day' ELSE 'second' END"""


@query(
    "precision_guard",
    f"""SELECT 'p'||(user_id % 8) AS project_id, max(CASE {_PRECISION_SQL} WHEN 'minute' THEN 60
 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 ELSE 1 END)::BIGINT AS floor_seconds,
 max(CASE {_PRECISION_SQL} WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600
 WHEN 'day' THEN 86400 ELSE 1 END) * 2 <= 120 AS accepted FROM events GROUP BY 1""",
)
def precision_guard(spark, sf):
    """Projects whose timestamps are too coarse for the rule are refused."""
    obs = table(spark, sf, "events").select(
        F.lit("t0").alias("tenant_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")).alias("project_id"),
        F.expr(_PRECISION_SQL).alias("timestamp_precision"),
    )
    return burst.precision_guard(obs, DEFAULT).select("project_id", "floor_seconds", "accepted")


@query(
    "sweep_diagnostics",
    f"""SELECT project_id, count(*) AS observations, count(DISTINCT account_id) AS accounts
 FROM ({OBS_SQL.format(project=BY_USER_GROUP)}) GROUP BY 1""",
)
def sweep_diagnostics(spark, sf):
    obs = sample.observations(spark, sf, sample.by_user_group())
    return burst.diagnostics(obs).drop("tenant_id")


@query(
    "observations_of_sources",
    f"""SELECT source_id, count(*) AS items, min(posted_at) AS first_at, max(posted_at) AS last_at
 FROM ({OBS_SQL.format(project=ALL)}) WHERE source_id IN (SELECT event_type FROM events
 GROUP BY event_type HAVING max(value) > 340) GROUP BY 1""",
)
def observations_of_sources(spark, sf):
    """Detection input restricted to a source list that is itself a table."""
    busy = (
        table(spark, sf, "events").groupBy(F.col("event_type").alias("source_id"))
        .agg(F.max("value").alias("v")).where("v > 340")
    )
    obs = burst.in_sources(burst.observations(sample.observations(spark, sf)), busy)
    return obs.groupBy("source_id").agg(
        F.count("*").alias("items"),
        plain(F.min("posted_at")).alias("first_at"),
        plain(F.max("posted_at")).alias("last_at"),
    )


@query(
    "hourly_counts_zero_filled",
    """WITH b AS (SELECT event_type AS source_id, date_trunc('hour', ts) AS hour, count(*) AS n
 FROM events GROUP BY 1, 2), c AS (SELECT source_id, unnest(generate_series(min(hour), max(hour),
 INTERVAL 1 HOUR)) AS hour FROM b GROUP BY source_id)
SELECT c.source_id, c.hour, coalesce(b.n, 0) AS items FROM c LEFT JOIN b
 ON b.source_id = c.source_id AND b.hour = c.hour""",
)
def hourly_counts(spark, sf):
    counts = baseline.hourly_counts(sample.observations(spark, sf))
    return counts.select("source_id", plain("hour").alias("hour"), "items")


_HOURLY = """WITH b AS (SELECT event_type AS source_id, date_trunc('hour', ts) AS hour,
 count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT source_id, unnest(generate_series(
 min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM b GROUP BY source_id), h AS (
 SELECT c.source_id, c.hour, coalesce(b.n, 0) AS items, (isodow(c.hour) - 1) * 24 + hour(c.hour)
 AS how FROM c LEFT JOIN b ON b.source_id = c.source_id AND b.hour = c.hour), p AS (
 SELECT source_id, how, count(*) AS samples, avg(items) AS mean, stddev_pop(items) AS stdev
 FROM h GROUP BY 1, 2)"""


@query(
    "baseline_profile",
    _HOURLY
    + """ SELECT source_id, CAST(how AS BIGINT) AS hour_of_week, samples, round(mean, 9) AS mean,
 round(stdev, 9) AS stdev FROM p""",
)
def baseline_profile(spark, sf):
    return _profile(baseline.span_profile(baseline.busy_hours(sample.observations(spark, sf))))


def _profile(profile):
    return profile.select(
        "source_id", F.col("hour_of_week").cast("long").alias("hour_of_week"), "samples",
        F.round("mean", 9).alias("mean"), F.round("stdev", 9).alias("stdev"),
    )


_YEARS = "(SELECT event_type, ts + (user_id % 5 - 2) * INTERVAL 1 YEAR AS ts FROM events WHERE event_type <> 'view')"


@query(
    "baseline_profile_years",
    _HOURLY.replace("FROM events", f"FROM {_YEARS}")
    + """ SELECT source_id, CAST(how AS BIGINT) AS hour_of_week, samples, round(mean, 9) AS mean,
 round(stdev, 9) AS stdev FROM p""",
)
def baseline_profile_years(spark, sf):
    """The profile over items of five years, most of them outside the expected months."""
    obs = sample.observations(spark, sf).where("source_id <> 'view'")
    year = F.make_interval(F.pmod(F.substring("account_id", 2, 20).cast("int"), F.lit(5)) - 2)
    return _profile(baseline.span_profile(baseline.busy_hours(obs.withColumn("posted_at", F.col("posted_at") + year))))


@query(
    "baseline_z",
    _HOURLY
    + """ SELECT h.source_id, h.hour, h.items, round(CASE WHEN p.samples >= 3 THEN
 CASE WHEN p.stdev = 0 THEN CASE WHEN h.items = p.mean THEN 0.0 WHEN h.items > p.mean THEN 3.0
 ELSE -3.0 END ELSE (h.items - p.mean) / p.stdev END END, 9) AS z
 FROM h JOIN p ON p.source_id = h.source_id AND p.how = h.how""",
)
def baseline_z(spark, sf):
    obs = sample.observations(spark, sf)
    scored = baseline.z_scores(baseline.hourly_counts(obs), baseline.span_profile(baseline.busy_hours(obs)))
    return scored.select(
        "source_id", plain("hour").alias("hour"), "items", F.round("z", 9).alias("z")
    )


@query(
    "volume_signals",
    _HOURLY.replace("WITH b AS", "WITH b AS", 1)
    + f""", z AS (SELECT h.source_id, h.hour, CASE WHEN p.samples >= 3 THEN
 CASE WHEN p.stdev = 0 THEN CASE WHEN h.items = p.mean THEN 0.0 WHEN h.items > p.mean THEN 3.0
 ELSE -3.0 END ELSE (h.items - p.mean) / p.stdev END END AS z
 FROM h JOIN p ON p.source_id = h.source_id AND p.how = h.how),
f AS (SELECT project_id, s, min(source_id) AS source_id FROM
 ({bursts_sql()} SELECT * FROM inside) GROUP BY 1, 2)
SELECT {FINDING_ID} AS finding_id, round(z.z, 9) AS z, z.z >= 3.0 AS passed FROM f LEFT JOIN z
 ON z.source_id = f.source_id AND z.hour = date_trunc('hour', make_timestamp(f.s))""",
)
def volume_signals(spark, sf):
    """The optional fourth signal: is the hour unusual for the source?"""
    obs = sample.observations(spark, sf)
    found = burst.detect(obs, DEFAULT)
    return baseline.volume_signal(found, baseline.busy_hours(obs)).select(
        "finding_id", F.round("signal.observed", 9).alias("z"), F.col("signal.passed").alias("passed")
    )


_WINDOW_SQL = f"""SELECT s.project_id, count(DISTINCT CAST(j.started_at AS DATE)) AS observed_days,
 CAST(greatest(1, date_diff('day', CAST(min(j.started_at) AS DATE),
 CAST(max(j.started_at) AS DATE)) + 1) AS BIGINT) AS window_days,
 max(j.started_at) AS last_collected_at FROM ({JOBS_SQL}) j JOIN ({JOB_SOURCES_SQL}) s
 ON s.source_id = j.source_id WHERE j.status = 'succeeded' GROUP BY 1"""


def _window(spark, sf):
    jobs = sample.jobs(spark, sf).join(
        sample.job_sources(spark, sf).select("source_id", "project_id"), "source_id"
    )
    return collect.observation_window(jobs, ["project_id"])


@query("observation_window", _WINDOW_SQL)
def observation_window(spark, sf):
    return _window(spark, sf).withColumn("last_collected_at", plain("last_collected_at"))


@query(
    "readiness",
    f"""WITH w AS ({_WINDOW_SQL}), r AS (SELECT *, observed_days / window_days AS coverage,
 CASE WHEN {NOW_SQL} - last_collected_at > INTERVAL 7 DAY AND observed_days >= 28 THEN 'stale'
 WHEN observed_days < 28 OR observed_days / window_days < 0.8 THEN 'collecting'
 ELSE 'ready' END AS status FROM w)
SELECT project_id, observed_days, window_days, round(coverage, 9) AS coverage, status,
 status = 'ready' AS may_fire FROM r""",
)
def readiness(spark, sf):
    out = baseline.readiness(_window(spark, sf), sample.now())
    return out.select(
        "project_id", "observed_days", "window_days",
        F.round("coverage", 9).alias("coverage"), "status", "may_fire",
    )


@query(
    "gated_observations",
    f"""WITH w AS ({_WINDOW_SQL}), ready AS (SELECT project_id FROM w WHERE observed_days >= 28
 AND observed_days / window_days >= 0.8 AND NOT {NOW_SQL} - last_collected_at > INTERVAL 7 DAY)
SELECT project_id, count(*) AS items FROM ({OBS_SQL.format(project=BY_USER_GROUP)})
 WHERE project_id IN (SELECT project_id FROM ready) GROUP BY 1""",
)
def gated_observations(spark, sf):
    """Only projects with a ready baseline reach the rule."""
    ready = baseline.readiness(_window(spark, sf), sample.now())
    obs = sample.observations(spark, sf, sample.by_user_group())
    return (
        baseline.ready_only(obs, ready, ["project_id"])
        .groupBy("project_id").agg(F.count("*").alias("items"))
    )


_HEALTH_SQL = f"""WITH j AS ({JOBS_SQL}), l AS (SELECT source_id,
 max(CASE WHEN status = 'succeeded' THEN {{{{'t': started_at, 'i': job_id}}}} END) AS ok
 FROM j GROUP BY 1), x AS (SELECT j.*, l.ok IS NULL OR {{{{'t': j.started_at, 'i': j.job_id}}}} > l.ok
 AS later FROM j JOIN l ON l.source_id = j.source_id), h AS (SELECT source_id,
 max(started_at) AS last_attempt_at, max(CASE WHEN status = 'succeeded' THEN started_at END)
 AS last_success_at, count(*) FILTER (WHERE later AND status <> 'succeeded')
 AS consecutive_failures, arg_max(CASE WHEN later AND status <> 'succeeded' THEN failure_reason
 END, {{{{'t': started_at, 'i': job_id}}}}) FILTER (WHERE later AND status <> 'succeeded')
 AS last_failure_reason FROM x GROUP BY 1)""".replace("{{", "{").replace("}}", "}")


def _health(spark, sf):
    return collect.source_health(sample.jobs(spark, sf))


@query("source_health", _HEALTH_SQL + " SELECT * FROM h")
def source_health(spark, sf):
    return (
        _health(spark, sf)
        .withColumn("last_attempt_at", plain("last_attempt_at"))
        .withColumn("last_success_at", plain("last_success_at"))
    )


@query(
    "due_sources",
    _HEALTH_SQL
    + f""" SELECT s.source_id, s.name, s.project_id, s.platform, s.priority FROM
 ({JOB_SOURCES_SQL}) s LEFT JOIN h ON h.source_id = s.source_id WHERE s.enabled AND
 (h.last_attempt_at IS NULL OR h.last_attempt_at <
 TIMESTAMP '2024-01-31 00:00:00' - to_seconds(s.interval_seconds))""",
)
def due_sources(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    due = collect.due_sources(sample.job_sources(spark, sf), _health(spark, sf), now)
    return due.select("source_id", "name", "project_id", "platform", "priority")


@query(
    "sources_for_display",
    _HEALTH_SQL
    + f""", f AS (SELECT source_id, min(started_at) AS since FROM j WHERE status = 'succeeded'
 GROUP BY 1) SELECT s.source_id, s.name, s.enabled, h.last_success_at, h.consecutive_failures,
 h.last_failure_reason, CAST(floor((epoch_us({NOW_SQL}) - epoch_us(f.since)) / 86400000000)
 AS BIGINT) AS observed_days, CASE s.platform WHEN 'html' THEN 'capture_only'
 WHEN 'facebook' THEN 'needs_route' WHEN 'x' THEN 'blocked' ELSE 'extracts' END AS support
 FROM ({JOB_SOURCES_SQL}) s LEFT JOIN h ON h.source_id = s.source_id
 LEFT JOIN f ON f.source_id = s.source_id""",
)
def sources_for_display(spark, sf):
    """Sources with health, the observation clock and platform support."""
    sources = collect.observing_since(sample.job_sources(spark, sf), sample.jobs(spark, sf))
    shown = collect.sources_for_display(sources, _health(spark, sf), sample.now())
    return shown.select(
        "source_id", "name", "enabled", plain("last_success_at").alias("last_success_at"),
        "consecutive_failures", "last_failure_reason", "observed_days", "support",
    )


@query(
    "recent_jobs",
    f"""SELECT j.job_id, j.source_id, s.name AS source_name, j.started_at, j.status
 FROM ({JOBS_SQL}) j JOIN ({JOB_SOURCES_SQL}) s ON s.source_id = j.source_id
 ORDER BY j.started_at DESC, j.job_id DESC LIMIT 50""",
)
def recent_jobs(spark, sf):
    jobs = collect.recent_jobs(sample.jobs(spark, sf), sample.job_sources(spark, sf))
    return jobs.select(
        "job_id", "source_id", "source_name", plain("started_at").alias("started_at"), "status"
    )


@query(
    "close_jobs",
    """SELECT event_id % 500 AS job_id, min(ts) AS started_at,
 max(CASE WHEN event_type <> 'view' THEN ts END) AS finished_at,
 arg_max(CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed_network'
 ELSE 'succeeded' END, {'t': ts, 'd': event_type <> 'view'}) AS status,
 arg_max(CAST(floor(value) AS BIGINT), {'t': ts, 'd': event_type <> 'view'}) AS bytes_fetched
 FROM events GROUP BY 1""",
)
def close_jobs(spark, sf):
    """A log of job events folded to the state of each job."""
    log = table(spark, sf, "events").select(
        (F.col("event_id") % 500).alias("job_id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") == "view", "running")
        .when(F.col("event_type") == "error", "failed_network")
        .otherwise("succeeded").alias("status"),
        F.floor("value").alias("bytes_fetched"),
        F.lit(None).cast("string").alias("capture_id"),
        F.lit(None).cast("string").alias("failure_reason"),
    )
    return collect.close_jobs(log).select(
        "job_id", plain("started_at").alias("started_at"),
        plain("finished_at").alias("finished_at"), "status", "bytes_fetched",
    )


@query(
    "run_summary",
    """WITH s AS (SELECT event_id // 8 AS run_id, event_id AS stage_no,
 CASE event_type WHEN 'click' THEN 'evidence' WHEN 'view' THEN 'extract' WHEN 'signup' THEN
 'detect' ELSE 'schedule' END AS stage, CASE WHEN event_type = 'error' AND value > 60 THEN 'failed'
 ELSE 'ok' END AS status, props AS detail, CASE WHEN event_type = 'purchase' THEN 1 END AS due,
 CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS items FROM events)
SELECT run_id, CAST(coalesce(sum(due), 0) AS BIGINT) AS sources_due,
 count(*) FILTER (WHERE stage = 'evidence' AND status = 'ok') AS captures,
 CAST(coalesce(sum(items), 0) AS BIGINT) AS items, CASE WHEN bool_or(status = 'failed')
 THEN 'failed' WHEN coalesce(sum(due), 0) = 0 THEN 'idle' ELSE 'ok' END AS outcome,
 CASE WHEN bool_or(status = 'failed') THEN arg_min(stage||': '||detail, stage_no)
 FILTER (WHERE status = 'failed') END AS failure FROM s GROUP BY 1""",
)
def run_summary(spark, sf):
    """Stages folded to runs: failed, idle or ok."""
    kind, none = F.col("event_type"), F.lit(None).cast("long")
    stages = table(spark, sf, "events").select(
        F.expr("event_id div 8").alias("run_id"),
        F.col("event_id").alias("stage_no"),
        F.when(kind == "click", "evidence").when(kind == "view", "extract")
        .when(kind == "signup", "detect").otherwise("schedule").alias("stage"),
        F.when((kind == "error") & (F.col("value") > 60), "failed").otherwise("ok")
        .alias("status"),
        F.col("props").alias("detail"),
        F.when(kind == "purchase", 1).alias("due"),
        F.when(kind == "view", F.floor("value")).alias("items"),
        none.alias("findings"), none.alias("exports"), none.alias("held_for_review"),
    )
    runs = collect.run_summary(stages)
    return runs.select(
        "run_id", "sources_due", "captures", "items", "outcome",
        F.when(F.col("outcome") == "failed", F.col("detail")).alias("failure"),
    )


@query(
    "scheduler_health",
    """WITH r AS (SELECT 't'||(user_id % 6) AS tenant_id, ts, event_id, event_type FROM events
 WHERE user_id % 6 <> 5), l AS (SELECT tenant_id, max(ts) AS ts, arg_max(CASE event_type
 WHEN 'error' THEN 'failed' WHEN 'view' THEN 'idle' ELSE 'ok' END, {'t': ts, 'i': event_id})
 AS outcome FROM r GROUP BY 1), t AS (SELECT DISTINCT 't'||(user_id % 6) AS tenant_id FROM events)
SELECT t.tenant_id, l.outcome AS last_outcome, CASE WHEN l.ts IS NULL THEN 'unverified'
 WHEN TIMESTAMP '2024-01-30 23:45:00' - l.ts > INTERVAL 300 SECOND THEN 'failed'
 WHEN l.outcome = 'failed' THEN 'failed' ELSE 'ok' END AS status
 FROM t LEFT JOIN l ON l.tenant_id = t.tenant_id""",
)
def scheduler_health(spark, sf):
    e = table(spark, sf, "events")
    tenant = F.concat(F.lit("t"), (F.col("user_id") % 6).cast("string"))
    runs = e.where(F.col("user_id") % 6 != 5).select(
        tenant.alias("tenant_id"),
        F.col("event_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "idle").otherwise("ok").alias("outcome"),
    )
    now = F.lit("2024-01-30 23:45:00").cast("timestamp")
    health = collect.scheduler_health(e.select(tenant.alias("tenant_id")).distinct(), runs, now)
    return health.select("tenant_id", "last_outcome", "status")


@query(
    "run_durations",
    """SELECT event_type, count(*) AS runs, sum(epoch_us(ts + to_milliseconds(
 CAST(floor(value * 1000) AS BIGINT))) - epoch_us(ts))::BIGINT AS micros FROM events GROUP BY 1""",
)
def run_durations(spark, sf):
    start = F.col("ts").cast("timestamp")
    finish = F.timestamp_micros(F.unix_micros(start) + F.floor(F.col("value") * 1000) * 1000)
    seconds = moments.run_seconds(start, finish)
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("runs"),
        F.sum(F.round(seconds * 1000).cast("long") * 1000).alias("micros"),
    )


_POSITIONS_SQL = f""", b AS ({BUNDLES_SQL}), c AS (SELECT project_id, s, capture_id,
 0 AS kind, capture_id AS cap, CAST(0 AS BIGINT) AS tt, '' AS item FROM inside
 UNION ALL SELECT project_id, s, last_capture_id, 1, '', t, content_id FROM inside),
pos AS (SELECT c.project_id, c.s, b.bundle_id, min({{'k': c.kind, 'c': c.cap, 't': c.tt,
 'i': c.item}}) AS rank FROM c JOIN b ON b.capture_id = c.capture_id GROUP BY 1, 2, 3)"""


def _positions(spark, sf):
    return review.evidence_positions(_inside(spark, sf), sample.bundles(spark, sf))


@query(
    "evidence_refs",
    bursts_sql()
    + _POSITIONS_SQL
    + f""" SELECT {FINDING_ID} AS finding_id, string_agg(bundle_id, ',' ORDER BY rank)
 AS evidence_refs FROM pos GROUP BY project_id, s""",
)
def evidence_refs(spark, sf):
    """Bundles behind each cluster, first-seen captures first, once each."""
    refs = review.evidence_refs(_positions(spark, sf))
    return refs.select("finding_id", F.array_join("evidence_refs", ",").alias("evidence_refs"))


@query(
    "unevidenced_clusters",
    bursts_sql()
    + _POSITIONS_SQL
    + f""", f AS (SELECT project_id, t AS s, n FROM win) SELECT {FINDING_ID} AS finding_id,
 n AS item_count FROM f WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.s = f.s)""",
)
def unevidenced_clusters(spark, sf):
    inside = materialise(_inside(spark, sf), "members")
    positions = review.evidence_positions(inside, sample.bundles(spark, sf))
    return review.unevidenced(burst.findings(inside, DEFAULT), positions).select(
        "finding_id", "item_count"
    )


@query(
    "dangling_refs",
    bursts_sql()
    + f""" SELECT 't0' AS tenant_id, count(*) AS dangling_findings FROM (SELECT DISTINCT s
 FROM inside WHERE 'b-'||capture_id NOT IN (SELECT bundle_id FROM ({BUNDLES_SQL})))
 HAVING count(*) > 0""",
)
def dangling_refs(spark, sf):
    """Findings that claim a bundle nobody can produce."""
    claims = burst.finding_captures(_inside(spark, sf)).select(
        "finding_id", "tenant_id", F.concat(F.lit("b-"), "capture_id").alias("bundle_id")
    )
    return review.dangling_references(claims, sample.bundles(spark, sf))


@query(
    "retention_expired",
    f"""SELECT source_id, count(*) AS captures, max(requested_at) AS newest FROM
 ({sample.CAPTURES_SQL}) WHERE epoch_us({NOW_SQL}) - epoch_us(requested_at) > 20 * 86400000000
 GROUP BY 1""",
)
def retention_expired(spark, sf):
    tenants = table(spark, sf, "events").groupBy(F.lit("t0").alias("tenant_id")).agg(
        F.lit(20).alias("retention_days")
    )
    gone = content.expired(sample.captures(spark, sf), tenants, sample.now(), "requested_at")
    return gone.groupBy("source_id").agg(
        F.count("*").alias("captures"), plain(F.max("requested_at")).alias("newest")
    )
