"""What is normal for a source: zero-filled hourly counts, the weekly profile, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import moments

# Thresholds of the baseline.
MINIMUM_SAMPLES = 3
FLAT_Z = 3.0
MINIMUM_OBSERVED_DAYS = 28
MINIMUM_COVERAGE = 0.8
STALE_AFTER_DAYS = 7


HOURS_OF_WEEK = 168


def busy_hours(obs: DataFrame) -> DataFrame:
    """Items per source and hour, for hours that have any."""
    return obs.where(F.col("posted_at").isNotNull()).groupBy(
        "source_id", F.date_trunc("hour", "posted_at").alias("hour")
    ).agg(F.count("*").alias("items"))


def spans(busy: DataFrame) -> DataFrame:
    """First and last busy hour of every source."""
    return busy.groupBy("source_id").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))


def hourly_counts(obs: DataFrame) -> DataFrame:
    """Items per source and hour; hours of silence inside the observed span count as 0.

    The rows of silent hours are the result here. What only needs the norm takes
    :func:`span_profile`, which makes no such rows.
    """
    busy = busy_hours(obs)
    calendar = spans(busy).select(
        "source_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour")
    )
    return calendar.join(busy, ["source_id", "hour"], "left").select(
        "source_id", "hour", F.coalesce("items", F.lit(0).cast("long")).alias("items")
    )


def span_profile(busy: DataFrame) -> DataFrame:
    """The profile of :func:`volume_profile` over the zero-filled hours, without filling them.

    How often an hour of the week lies between a source's first and last hour is arithmetic,
    and silent hours add nothing to sums of items and squares. So the work follows the busy
    hours, whatever the span: one wrong date costs nothing. Sums are exact.
    """
    how = moments.hour_of_week(F.col("hour"))
    items = F.col("items").cast("decimal(19,0)")
    sums = busy.groupBy("source_id", how.alias("hour_of_week")).agg(
        F.sum("items").alias("s1"), F.sum(items * items).cast("decimal(38,0)").alias("s2")
    )
    length = F.floor((F.unix_timestamp("hi") - F.unix_timestamp("lo")) / 3600)
    offset = F.pmod(F.col("hour_of_week") - moments.hour_of_week(F.col("lo")), F.lit(HOURS_OF_WEEK))
    every = (
        spans(busy)
        .withColumn("hour_of_week", F.explode(F.sequence(F.lit(0), F.lit(HOURS_OF_WEEK - 1))))
        .select("source_id", "hour_of_week", (F.floor((length - offset) / HOURS_OF_WEEK) + 1).alias("samples"))
        .where("samples > 0")
    )
    n = F.col("samples")
    s1, s2 = F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0).cast("decimal(38,0)"))
    # n s2 - s1^2 in whole numbers, so a flat hour has a deviation of exactly zero
    spread = n.cast("decimal(10,0)") * s2.cast("decimal(28,0)") - s1.cast("decimal(19,0)") * s1.cast("decimal(19,0)")
    return every.join(sums, ["source_id", "hour_of_week"], "left").select(
        "source_id", "hour_of_week", "samples",
        (s1 / n).alias("mean"), (F.sqrt(spread.cast("double")) / n).alias("stdev"),
    )


def scores_at(asked: DataFrame, busy: DataFrame) -> DataFrame:
    """``z`` of the (source_id, hour) rows in ``asked`` that lie in their source's span."""
    inside = (
        asked.select("source_id", "hour").distinct().join(spans(busy), "source_id")
        .where("hour between lo and hi").select("source_id", "hour")
    )
    counts = inside.join(busy, ["source_id", "hour"], "left").select(
        "source_id", "hour", F.coalesce("items", F.lit(0).cast("long")).alias("items")
    )
    return z_scores(counts, span_profile(busy))


def volume_profile(counts: DataFrame) -> DataFrame:
    """Per source and hour of week: samples, mean, population deviation."""
    return counts.groupBy(
        "source_id", moments.hour_of_week(F.col("hour")).alias("hour_of_week")
    ).agg(
        F.count("*").alias("samples"),
        F.avg("items").alias("mean"),
        F.stddev_pop("items").alias("stdev"),
    )


def z_of(items: Column) -> Column:
    """Needs samples, mean and stdev beside it. Null means no opinion, not normal."""
    flat = (
        F.when(items == F.col("mean"), F.lit(0.0))
        .when(items > F.col("mean"), F.lit(FLAT_Z))
        .otherwise(F.lit(-FLAT_Z))
    )
    return F.when(
        F.col("samples") >= MINIMUM_SAMPLES,
        F.when(F.col("stdev") == 0, flat).otherwise((items - F.col("mean")) / F.col("stdev")),
    )


def z_scores(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """Each hourly count against the norm for its hour of the week."""
    keyed = counts.withColumn("hour_of_week", moments.hour_of_week(F.col("hour")))
    return keyed.join(profile, ["source_id", "hour_of_week"], "left").withColumn(
        "z", z_of(F.col("items"))
    )


def readiness(window: DataFrame, now: Column) -> DataFrame:
    """collecting, stale or ready, with coverage and the reason.

    ``window`` has observed_days, window_days and last_collected_at; scopes that never
    collected anything have 0, 0 and null.
    """
    days, span = F.col("observed_days"), F.col("window_days")
    coverage = F.when(span > 0, days / span).otherwise(F.lit(0.0))
    silent = moments.micros(now) - moments.micros(F.col("last_collected_at"))
    silent_days = F.floor(silent / (86400 * moments.MICROS))
    long_silent = silent > STALE_AFTER_DAYS * 86400 * moments.MICROS
    enough = days >= MINIMUM_OBSERVED_DAYS
    never = F.col("last_collected_at").isNull()
    thin = coverage < MINIMUM_COVERAGE
    status = (
        F.when(never, F.lit("collecting"))
        .when(long_silent & enough, F.lit("stale"))
        .when(~enough | thin, F.lit("collecting"))
        .otherwise(F.lit("ready"))
    )
    percent = F.round(coverage * 100).cast("int")
    reason = (
        F.when(never, F.lit("nothing collected yet"))
        .when(long_silent & enough, F.format_string("nothing collected for %d days", silent_days))
        .when(~enough, F.format_string(f"%d of {MINIMUM_OBSERVED_DAYS} observed days", days))
        .when(thin, F.format_string("%d days in %d (%d%% coverage)", days, span, percent))
        .otherwise(
            F.format_string("%d days, %d%% coverage, last %d days ago", days, percent, silent_days)
        )
    )
    return (
        window.withColumn("coverage", coverage)
        .withColumn("status", status)
        .withColumn("reason", reason)
        .withColumn("may_fire", status == "ready")
    )


def ready_only(obs: DataFrame, readiness_by_scope: DataFrame, scope: list[str]) -> DataFrame:
    """Observations of scopes whose baseline may be used."""
    return obs.join(readiness_by_scope.where("may_fire").select(*scope), scope, "left_semi")


def volume_signal(finding_sources: DataFrame, busy: DataFrame, threshold: float = FLAT_Z):
    """Optional fourth signal: the z-score of the hour a cluster falls in. Off by default."""
    hours = finding_sources.withColumn("hour", F.date_trunc("hour", "window_start"))
    scored = scores_at(hours, busy)
    return hours.join(scored.select("source_id", "hour", "z"), ["source_id", "hour"], "left").select(
        "finding_id",
        F.struct(
            F.lit("volume_z").alias("name"),
            F.col("z").alias("observed"),
            F.lit(threshold).alias("threshold"),
            (F.col("z") >= threshold).alias("passed"),
            F.lit("volume against the norm for this hour of the week").alias("description"),
        ).alias("signal"),
    )
