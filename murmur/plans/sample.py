"""The model's tables, built from the driver's tables. SQL twins of each are below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.plans.registry import table

#: A fixed "now" after the last event, so results do not depend on the clock.
NOW = "2024-02-01 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHH")


def observations(spark: SparkSession, sf: str, project: Column | None = None) -> DataFrame:
    """Events as posts: the type is the source, the hour of a source one capture of it."""
    e = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.lit("t0").alias("tenant_id"),
        (F.lit("all") if project is None else project).alias("project_id"),
        F.col("event_type").alias("source_id"),
        F.col("event_id").cast("string").alias("content_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("account_id"),
        F.concat_ws("-", "event_type", hour_label(ts)).alias("capture_id"),
        F.concat_ws("-", "event_type", hour_label(ts + F.expr("interval 1 hour"))).alias(
            "last_capture_id"
        ),
        ts.alias("posted_at"),
        F.lit("second").alias("timestamp_precision"),
    )


def by_user_group() -> Column:
    return F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))


OBS_SQL = """SELECT 't0' AS tenant_id, {project} AS project_id, event_type AS source_id,
 CAST(event_id AS VARCHAR) AS content_id, 'u'||user_id AS account_id,
 event_type||'-'||strftime(ts,'%Y%m%d%H') AS capture_id,
 event_type||'-'||strftime(ts + INTERVAL 1 HOUR,'%Y%m%d%H') AS last_capture_id,
 ts AS posted_at, epoch_us(ts) AS t FROM events"""
ALL = "'all'"
BY_USER_GROUP = "'p'||(user_id % 4)"


def bursts_sql(project: str = ALL, window: int = 120, items: int = 4, accounts: int = 3) -> str:
    """CTEs obs, cand, nxt, pick and win; to be followed by a SELECT."""
    w = window * 1_000_000
    return f"""WITH RECURSIVE obs AS MATERIALIZED ({OBS_SQL.format(project=project)}),
starts AS (SELECT DISTINCT project_id, t FROM obs),
cand AS MATERIALIZED (SELECT s.project_id, s.t, count(*) AS n, count(DISTINCT o.account_id) AS a, max(o.t) AS e
 FROM starts s JOIN obs o ON o.project_id = s.project_id AND o.t BETWEEN s.t AND s.t + {w}
 GROUP BY 1, 2 HAVING count(*) >= {items} AND count(DISTINCT o.account_id) >= {accounts}),
nxt AS MATERIALIZED (SELECT c.project_id, c.t, d.t AS nt FROM cand c ASOF LEFT JOIN cand d
 ON c.project_id = d.project_id AND c.e < d.t),
pick AS (SELECT project_id, min(t) AS t FROM cand GROUP BY 1
 UNION ALL SELECT n.project_id, n.nt FROM pick p JOIN nxt n
 ON n.project_id = p.project_id AND n.t = p.t WHERE n.nt IS NOT NULL),
win AS (SELECT c.* FROM pick p JOIN cand c ON c.project_id = p.project_id AND c.t = p.t),
inside AS (SELECT w.t AS s, w.e, o.* FROM win w JOIN obs o
 ON o.project_id = w.project_id AND o.t BETWEEN w.t AND w.e)"""


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """One row per source and hour with activity."""
    e = table(spark, sf, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return (
        e.groupBy("event_type", hour.alias("requested_at"))
        .agg(F.count("*").alias("bytes_transferred"))
        .select(
            F.lit("t0").alias("tenant_id"),
            F.concat_ws("-", "event_type", hour_label(F.col("requested_at"))).alias("capture_id"),
            F.col("event_type").alias("source_id"),
            F.concat(F.lit("tr-"), hour_label(F.col("requested_at"))).alias("trace_id"),
            F.concat(F.lit("https://"), "event_type", F.lit(".example.org/")).alias("url"),
            "requested_at",
            F.lit("succeeded").alias("status"),
            "bytes_transferred",
        )
    )


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Sealed captures; those of the hours 3 and 4 have expired."""
    c = captures(spark, sf).where(~F.hour("requested_at").isin(3, 4))
    return c.select(
        "tenant_id",
        F.concat(F.lit("b-"), "capture_id").alias("bundle_id"),
        "capture_id",
        "trace_id",
        F.col("url").alias("source_url"),
        F.col("requested_at").alias("captured_at"),
        F.sha2("capture_id", 256).alias("manifest_sha256"),
        F.abs(F.xxhash64("capture_id")).alias("chain_index"),
    )


CAPTURES_SQL = """SELECT 't0' AS tenant_id,
 event_type||'-'||strftime(date_trunc('hour', ts),'%Y%m%d%H') AS capture_id,
 event_type AS source_id, 'tr-'||strftime(date_trunc('hour', ts),'%Y%m%d%H') AS trace_id,
 'https://'||event_type||'.example.org/' AS url, date_trunc('hour', ts) AS requested_at,
 'succeeded' AS status, count(*) AS bytes_transferred
 FROM events GROUP BY event_type, date_trunc('hour', ts)"""
BUNDLES_SQL = f"""SELECT tenant_id, 'b-'||capture_id AS bundle_id, capture_id, trace_id,
 url AS source_url, requested_at AS captured_at, sha256(capture_id) AS manifest_sha256
 FROM ({CAPTURES_SQL}) WHERE hour(requested_at) NOT IN (3, 4)"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as fetch jobs of twenty sources; two event types are failures."""
    e = table(spark, sf, "events")
    failed = F.col("event_type").isin("error", "signup")
    return e.select(
        F.col("event_id").alias("job_id"),
        F.format_string("s%02d", F.col("user_id") % 20).alias("source_id"),
        F.col("ts").cast("timestamp").alias("scheduled_for"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.when(failed, F.lit("failed_network")).otherwise(F.lit("succeeded")).alias("status"),
        F.when(failed, F.concat_ws(" ", "event_type", "props")).alias("failure_reason"),
    )


JOBS_SQL = """SELECT event_id AS job_id, 's'||lpad(CAST(user_id % 20 AS VARCHAR),2,'0') AS source_id,
 ts AS started_at, CASE WHEN event_type IN ('error','signup') THEN 'failed_network'
 ELSE 'succeeded' END AS status, CASE WHEN event_type IN ('error','signup')
 THEN event_type||' '||props END AS failure_reason FROM events"""


def job_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The sources the jobs belong to, with intervals and switches that vary."""
    e = table(spark, sf, "events")
    n = F.col("n")
    return (
        e.select((F.col("user_id") % 20).alias("n"))
        .distinct()
        .select(
            F.lit("t0").alias("tenant_id"),
            F.format_string("s%02d", n).alias("source_id"),
            F.concat(F.lit("source "), n.cast("string")).alias("name"),
            F.concat(F.lit("p"), (n % 4).cast("string")).alias("project_id"),
            F.when(n % 5 == 0, "html").when(n % 5 == 1, "facebook").when(n % 5 == 2, "x")
            .otherwise("telegram").alias("platform"),
            (n % 7 != 3).alias("enabled"),
            (1 + n % 10).cast("int").alias("priority"),
            (n * 1800 + 60).cast("int").alias("interval_seconds"),
            F.lit(None).cast("timestamp").alias("observing_since"),
        )
    )


JOB_SOURCES_SQL = """SELECT DISTINCT 't0' AS tenant_id,
 's'||lpad(CAST(user_id % 20 AS VARCHAR),2,'0') AS source_id, 'source '||(user_id % 20) AS name,
 'p'||(user_id % 20 % 4) AS project_id, CASE user_id % 20 % 5 WHEN 0 THEN 'html'
 WHEN 1 THEN 'facebook' WHEN 2 THEN 'x' ELSE 'telegram' END AS platform,
 (user_id % 20 % 7) <> 3 AS enabled, CAST(1 + user_id % 20 % 10 AS INTEGER) AS priority,
 CAST(user_id % 20 * 1800 + 60 AS INTEGER) AS interval_seconds FROM events"""
