"""Sources, fetch jobs and scheduler runs: health, due work, observation, ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import addresses, ids, moments
from murmur.functions.text import strip

# Fixed value: how long the scheduler may be silent.
SCHEDULER_SILENCE_SECONDS = 300


def attempt() -> Column:
    """Jobs of a source in order; the id breaks ties."""
    return F.struct("started_at", "job_id")


def succeeded() -> Column:
    return F.col("status") == "succeeded"


def source_health(jobs: DataFrame) -> DataFrame:
    """Last attempt, last success, failures since then and the reason of the latest one.

    The first pass finds each source's last success; the second counts what came after. Both
    combine map-side, and the small side of the join between them is one row per source.
    """
    done = jobs.where(F.col("status") != "running")
    last = done.groupBy("source_id").agg(F.max(F.when(succeeded(), attempt())).alias("success"))
    later = F.col("success").isNull() | (attempt() > F.col("success"))
    return (
        done.join(last, "source_id")
        .groupBy("source_id")
        .agg(
            F.max("started_at").alias("last_attempt_at"),
            F.max(F.when(succeeded(), F.col("started_at"))).alias("last_success_at"),
            F.count_if(later & ~succeeded()).alias("consecutive_failures"),
            F.max_by(
                F.when(later & ~succeeded(), F.col("failure_reason")), attempt()
            ).alias("last_failure_reason"),
        )
    )


def sources_for_display(sources: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Sources with their health, days observed and what the platform supports."""
    return sources.join(health, "source_id", "left").select(
        *[c for c in sources.columns],
        "last_attempt_at",
        "last_success_at",
        F.coalesce("consecutive_failures", F.lit(0).cast("long")).alias("consecutive_failures"),
        "last_failure_reason",
        moments.observed_days(F.col("observing_since"), now).alias("observed_days"),
        addresses.platform_support(F.col("platform")).alias("support"),
    )


def due_sources(sources: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Enabled sources never tried, or last tried longer ago than their interval."""
    limit = moments.micros(now) - F.col("interval_seconds").cast("long") * moments.MICROS
    return (
        sources.where("enabled")
        .join(health.select("source_id", "last_attempt_at"), "source_id", "left")
        .where(
            F.col("last_attempt_at").isNull()
            | (moments.micros(F.col("last_attempt_at")) < limit)
        )
        .orderBy("priority", "name", "source_id")
    )


def observation_window(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Distinct UTC days with a success, the span they fall in, and the latest success."""
    day = F.to_date("started_at")
    daily = (
        jobs.where(succeeded())
        .groupBy(*by, day.alias("day"))
        .agg(F.max("started_at").alias("last"))
    )
    return daily.groupBy(*by).agg(
        F.count("*").alias("observed_days"),
        F.greatest(F.lit(1), F.datediff(F.max("day"), F.min("day")) + 1)
        .cast("long")
        .alias("window_days"),
        F.max("last").alias("last_collected_at"),
    )


def observing_since(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Start the clock at the first success where it has not started yet; never restart it."""
    first = jobs.where(succeeded()).groupBy("source_id").agg(F.min("started_at").alias("first"))
    return sources.join(first, "source_id", "left").withColumn(
        "observing_since", F.coalesce("observing_since", "first")
    ).drop("first")


def close_jobs(events: DataFrame) -> DataFrame:
    """Job event log to current state: the latest event decides status, size and reason."""
    order = F.struct("at", F.when(F.col("status") == "running", 0).otherwise(1))
    return events.groupBy("job_id").agg(
        F.min("at").alias("started_at"),
        F.max_by(F.struct("status", "bytes_fetched", "capture_id", "failure_reason"), order)
        .alias("s"),
        F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"),
    ).select("job_id", "started_at", "finished_at", "s.*")


def recent_jobs(jobs: DataFrame, sources: DataFrame, limit: int = 50) -> DataFrame:
    """Newest jobs with the name of their source; every job has one, so the limit comes first."""
    names = sources.select("source_id", F.col("name").alias("source_name"))
    newest = jobs.orderBy(F.desc("scheduled_for"), F.desc("job_id")).limit(limit)
    return newest.join(names, "source_id", "left")


def newest(table: DataFrame, column: str, tie: str, limit: int) -> DataFrame:
    """Top rows by a time or index, newest first, with a unique tie-break."""
    return table.orderBy(F.desc(column), F.desc(tie)).limit(limit)


def by_name(table: DataFrame, name: str, tie: str, limit: int | None = None) -> DataFrame:
    """A list by name, or its first rows, with a unique tie-break."""
    rows = table.orderBy(name, tie)
    return rows if limit is None else rows.limit(limit)


#: Characters of a failure shown in a run's ``detail``; the whole text is in ``failure``.
DETAIL_CHARS = 500


def run_summary(stages: DataFrame, detail_chars: int = DETAIL_CHARS) -> DataFrame:
    """Stage rows to one row per run: failed, idle or ok, with the totals.

    ``stages`` has run_id, stage_no, stage, status, detail, due, items, findings, exports and
    held_for_review. Captures are counted by stage, as the evidence stage reports an index.
    """

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)

    failed = F.col("status") == "failed"
    label = F.concat(F.col("stage"), F.lit(": "), F.col("detail"))
    runs = stages.groupBy("run_id").agg(
        total("due").alias("sources_due"),
        F.count_if((F.col("stage") == "evidence") & (F.col("status") == "ok")).alias("captures"),
        total("items"),
        total("findings"),
        total("exports"),
        total("held_for_review"),
        F.min_by(F.when(failed, label), F.when(failed, F.col("stage_no"))).alias("failure"),
    )
    outcome = (
        F.when(F.col("failure").isNotNull(), F.lit("failed"))
        .when(F.col("sources_due") == 0, F.lit("idle"))
        .otherwise(F.lit("ok"))
    )
    detail = (
        F.when(F.col("failure").isNotNull(), F.substring("failure", 1, detail_chars))
        .when(F.col("sources_due") == 0, F.lit("no source was due"))
        .otherwise(
            F.format_string(
                "%d due, %d captures, %d items, %d findings, %d held for review",
                "sources_due", "captures", "items", "findings", "held_for_review",
            )
        )
    )
    return runs.withColumn("outcome", outcome).withColumn("detail", detail)


def scheduler_health(tenants: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """unverified (never ran), failed (silent or last run failed) or ok, per tenant."""
    last = runs.groupBy("tenant_id").agg(
        F.max_by(F.struct("started_at", "outcome"), F.struct("started_at", "run_id")).alias("r")
    )
    age = F.floor((moments.micros(now) - moments.micros(F.col("r.started_at"))) / moments.MICROS)
    status = (
        F.when(F.col("r").isNull(), F.lit("unverified"))
        .when(
            moments.micros(now) - moments.micros(F.col("r.started_at"))
            > SCHEDULER_SILENCE_SECONDS * moments.MICROS,
            F.lit("failed"),
        )
        .when(F.col("r.outcome") == "failed", F.lit("failed"))
        .otherwise(F.lit("ok"))
    )
    return tenants.select("tenant_id").join(last, "tenant_id", "left").select(
        "tenant_id",
        status.alias("status"),
        age.alias("seconds_since_run"),
        F.col("r.outcome").alias("last_outcome"),
    )


def source_lines(pasted: DataFrame) -> DataFrame:
    """(list_id, platform, pasted) to one row per usable line with its position."""
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029,]"
    return (
        pasted.select(
            *[c for c in pasted.columns if c != "pasted"],
            F.posexplode(F.split("pasted", breaks)).alias("line_no", "line"),
        )
        .withColumn("line", strip(F.col("line")))
        .where((F.col("line") != "") & ~F.col("line").startswith("#"))
    )


def ingest_sources(lines: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Each line as added, duplicate or rejected.

    ``lines`` has tenant_id, platform, line and ``seq``, a unique reading order. The first
    line that names an address counts; a page the tenant already watches under another id is
    a duplicate. The winner is found by an aggregate, so a much repeated address is no task
    of its own.
    """
    parsed = lines.withColumn("n", addresses.normalise_source(F.col("line"), F.col("platform")))
    parsed = parsed.select(
        *lines.columns,
        F.col("n.name").alias("name"),
        F.col("n.url").alias("url"),
        F.col("n.reason").alias("reason"),
        ids.source_id(F.col("platform"), F.col("n.url")).alias("source_id"),
    )
    good = parsed.where(F.col("reason").isNull())
    first = good.groupBy("tenant_id", "source_id").agg(F.min("seq").alias("seq"))
    first = first.withColumn("is_first", F.lit(True))
    out = good.join(first, ["tenant_id", "source_id", "seq"], "left")
    if existing is not None:
        watched = existing.groupBy("tenant_id", "url").agg(
            F.min("source_id").alias("existing_id")
        )
        out = out.join(watched, ["tenant_id", "url"], "left")
    else:
        out = out.withColumn("existing_id", F.lit(None).cast("string"))
    elsewhere = F.col("existing_id").isNotNull() & (F.col("existing_id") != F.col("source_id"))
    outcome = F.when(F.col("is_first").isNull() | elsewhere, F.lit("duplicate")).otherwise(
        F.lit("added")
    )
    columns = [*lines.columns, "name", "url", "reason", "source_id"]
    bad = parsed.where(F.col("reason").isNotNull()).withColumn(
        "source_id", F.lit(None).cast("string")
    )
    return (
        out.withColumn("outcome", outcome)
        .select(*columns, "outcome")
        .unionByName(bad.select(*columns).withColumn("outcome", F.lit("rejected")))
    )


def duplicate_sources(sources: DataFrame) -> DataFrame:
    """Sources of the same tenant and address other than the earliest."""
    keep = sources.groupBy("tenant_id", "url").agg(
        F.min_by("source_id", F.struct("created_at", "source_id")).alias("kept_id")
    )
    return sources.join(keep, ["tenant_id", "url"]).where(F.col("source_id") != F.col("kept_id"))


def without_sources(table: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop the health rows of removed sources."""
    return table.join(removed.select("source_id"), "source_id", "left_anti")
