"""Queries of sinks, published views, backfills and lists; sinks are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import ids
from murmur.operators import burst, collect, content, sinks
from murmur.plans import extraction, sample
from murmur.plans.detection import FINDING_ID
from murmur.plans.registry import plain, query, table, uuid5_sql
from murmur.plans.sample import bursts_sql
from murmur.session import materialise, work_dir
from murmur.sources import tables
from murmur.sources.snapshots import Store


@query(
    "findings_saved",
    bursts_sql()
    + f"""SELECT {FINDING_ID} AS finding_id, any_value(run) AS run_id, count(*) AS items,
 count(DISTINCT account_id) AS accounts, count(DISTINCT capture_id) AS captures
 FROM (SELECT *, 'r1' AS run FROM inside) GROUP BY project_id, s""",
)
def findings_saved(spark, sf):
    """Findings, accounts and captures written as one run, twice, and read back."""
    path = work_dir(spark, "findings")
    obs = sample.observations(spark, sf)
    rules = [burst.BurstRule()]
    # the second attempt at the run finds the membership that the first one wrote
    inside = sinks.membership(obs, rules)
    for _ in range(2):
        sinks.write_findings(obs, rules, path, "r1", inside)
    accounts = sinks.read_findings(spark, path, "finding_accounts").groupBy("finding_id").agg(
        F.count("*").alias("accounts")
    )
    captures = sinks.read_findings(spark, path, "finding_captures").groupBy("finding_id").agg(
        F.count("*").alias("captures")
    )
    return (
        sinks.read_findings(spark, path)
        .join(accounts, "finding_id").join(captures, "finding_id")
        .select("finding_id", "run_id", F.col("item_count").alias("items"), "accounts", "captures")
    )


@query(
    "runs_saved",
    """SELECT capture_id, items, rejected, validation_passed, TIMESTAMP '2024-02-01' AS validated_at
 FROM (""" + extraction.VALIDATION_SQL + ") UNION ALL SELECT capture_id, items, rejected, "
    "validation_passed, TIMESTAMP '2024-02-02' FROM (" + extraction.VALIDATION_SQL + ")",
)
def runs_saved(spark, sf):
    """Two validations of every capture, kept beside each other; each job ran twice."""
    path = work_dir(spark, "runs")
    # validated once; the four jobs read what was found
    runs = materialise(extraction.capture_validation(spark, sf), "validated")
    for day in ("2024-02-01", "2024-02-02"):
        for _ in range(2):
            sinks.append_runs(runs, path, F.lit(day).cast("timestamp"), day)
    return Store(spark, path).state().read("runs").withColumn("validated_at", plain("validated_at"))


def _exports(spark, sf):
    """Two days of exports of all findings; the second job was repeated."""
    path = work_dir(spark, "exports")
    found = burst.detect(sample.observations(spark, sf), [burst.BurstRule()]).select(
        "finding_id", F.concat(F.lit('{"id":"'), "finding_id", F.lit('"}')).alias("bundle_json")
    )
    for day in ("2024-02-01", "2024-02-02", "2024-02-02"):
        sinks.append_exports(found, path, F.lit(day).cast("timestamp"), day)
    rows = Store(spark, path).state().read("exports")
    return rows.select("export_id", "finding_id", "bundle_json", plain("created_at").alias("created_at"))


_EXPORTS_SQL = (
    bursts_sql()
    + f""", f AS (SELECT {FINDING_ID} AS finding_id FROM inside GROUP BY project_id, s),
x AS (SELECT finding_id, '{{"id":"'||finding_id||'"}}' AS bundle_json, created_at FROM f,
 (VALUES (TIMESTAMP '2024-02-01'), (TIMESTAMP '2024-02-02')) d(created_at))
SELECT """
    + uuid5_sql(ids.CONTENT_NAMESPACE, "'export|'||finding_id||'|'||epoch_us(created_at)")
    + " AS export_id, finding_id, bundle_json, created_at FROM x"
)


@query("exports_saved", _EXPORTS_SQL)
def exports_saved(spark, sf):
    """Every export that was ever made, once."""
    return _exports(spark, sf)


@query(
    "recent_exports",
    f"SELECT export_id, finding_id, created_at FROM ({_EXPORTS_SQL}) ORDER BY created_at DESC, export_id DESC LIMIT 50",
)
def recent_exports(spark, sf):
    """The newest exports."""
    return collect.newest(_exports(spark, sf), "created_at", "export_id", 50).select(
        "export_id", "finding_id", "created_at"
    )


@query(
    "content_stored",
    extraction.REOBSERVED_SQL,
)
def content_stored(spark, sf):
    """Two batches merged into stored months, the first one delivered again after the second."""
    store = Store(spark, work_dir(spark, "content"))
    batch = extraction.content_sightings(spark, sf)
    for number, rows in enumerate([batch.where("early"), batch.where("not early")]):
        content.merge_stored_content(store, rows.drop("early"), number)
    content.merge_stored_content(store, batch.where("early").drop("early"), 0)
    return extraction.reobserved(store.state().read("content"))


@query(
    "recent_runs",
    "SELECT capture_id, items FROM (" + extraction.VALIDATION_SQL + ") ORDER BY items DESC, capture_id DESC LIMIT 50",
)
def recent_runs(spark, sf):
    """Top rows of the run log."""
    return collect.newest(extraction.capture_validation(spark, sf), "items", "capture_id", 50).select(
        "capture_id", "items"
    )


@query(
    "provenance_view",
    f"""SELECT content_id, capture_id, last_capture_id, 'tr-'||content_id AS trace_id
 FROM ({sample.OBS_SQL.format(project=sample.ALL)})""",
)
def provenance_view(spark, sf):
    """Where every item came from, and nothing it said."""
    rows = sample.observations(spark, sf).withColumns(
        {
            "trace_id": F.concat(F.lit("tr-"), "content_id"),
            "last_trace_id": F.concat(F.lit("tr-"), "content_id"),
            "extractor_version": F.lit(2),
            "text": F.col("content_id"),
        }
    )
    seen = tables.content_provenance(rows)
    return seen.select("content_id", "capture_id", "last_capture_id", "trace_id")


@query(
    "accounts_view",
    """SELECT 't0' AS tenant_id, 'u'||c_custkey AS account_id, 'html' AS platform, c_mktsegment AS handle
 FROM customer""",
)
def accounts_view(spark, sf):
    """Accounts as exports see them, without the display name."""
    c = table(spark, sf, "customer")
    accounts = c.select(
        F.lit("t0").alias("tenant_id"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("account_id"),
        F.lit("html").alias("platform"), F.col("c_mktsegment").alias("handle"),
        F.col("c_name").alias("display_name"),
    )
    return tables.accounts_for_export(accounts)


@query(
    "project_scope",
    "SELECT event_type AS source_id, count(*) AS items FROM events WHERE user_id % 4 = 2 GROUP BY 1",
)
def project_scope(spark, sf):
    """One project's rows; there is no way to ask for all projects."""
    obs = sample.observations(spark, sf, sample.by_user_group())
    return tables.for_project(obs, "p2").groupBy("source_id").agg(F.count("*").alias("items"))


@query(
    "backfilled",
    """SELECT CAST(event_id AS VARCHAR) AS content_id, CASE WHEN event_id % 3 = 0 THEN 'old' ELSE
 'p'||(user_id % 4) END AS project_id, CASE WHEN event_id % 2 = 0 THEN 'c'||event_id ELSE
 'l'||event_id END AS last_capture_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 1 HOUR
 END AS last_seen FROM events""",
)
def backfilled(spark, sf):
    """Rows from before the last_* columns and projects existed."""
    e = table(spark, sf, "events")
    ts, eid, later = F.col("ts").cast("timestamp"), F.col("event_id").cast("string"), F.col("event_id") % 2 != 0
    rows = e.select(
        eid.alias("content_id"),
        F.when(F.col("event_id") % 3 != 0, sample.by_user_group()).alias("project_id"),
        F.concat(F.lit("c"), eid).alias("capture_id"),
        F.when(later, F.concat(F.lit("l"), eid)).alias("last_capture_id"),
        F.concat(F.lit("tr"), eid).alias("trace_id"),
        F.lit(None).cast("string").alias("last_trace_id"),
        ts.alias("first_seen"),
        F.when(later, ts + F.expr("interval 1 hour")).alias("last_seen"),
    )
    done = content.backfill_project(content.backfill_last(rows), "old")
    return done.select("content_id", "project_id", "last_capture_id", plain("last_seen").alias("last_seen"))


@query(
    "sources_by_name",
    "SELECT c_name AS name, c_custkey AS source_id FROM customer",
)
def sources_by_name(spark, sf):
    """All sources in the order of their names; the id breaks ties."""
    named = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("source_id"))
    return collect.by_name(named, "name", "source_id")
