"""Stream queries that the engine's own event-time state is enough for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import baseline
from murmur.operators.burst import SCOPE, BurstRule

#: Sketches hold 2^12 registers: an error of 1.6 percent, and next to none below some 400
#: accounts. The slack given for it is far wider, so no possible burst is lost.
SKETCH_BITS = 12
SKETCH_SLACK = 0.7


def panes(stream: DataFrame, rule: BurstRule, delay: str) -> DataFrame:
    """Items and account sketch of every pane, one rule window long, once it is closed.

    A row is counted once, in its pane. An empty account name is an account, no name is none.
    """
    account = F.concat(F.lit("a"), F.col("account_id"))
    return (
        stream.withWatermark("posted_at", delay)
        .groupBy(*SCOPE, F.window("posted_at", f"{rule.window_seconds} seconds").alias("pane"))
        .agg(
            F.count("*").alias("items"),
            F.hll_sketch_agg(account, SKETCH_BITS).alias("sketch"),
        )
    )


def busy_windows(stream: DataFrame, rule: BurstRule, delay: str) -> DataFrame:
    """Sliding windows in which a burst is possible.

    Every rule window lies inside one window of twice its length that slides by its length,
    so this is a necessary condition. Such a window is two panes, whose counts are added and
    whose sketches are united. Items are exact; accounts are compared with slack. What it
    lets through is decided by the exact rule. A row behind the watermark of its pane is late.
    """
    width = f"{2 * rule.window_seconds} seconds"
    slide = f"{rule.window_seconds} seconds"
    counted = (
        panes(stream, rule, delay)
        .groupBy(*SCOPE, F.window("pane", width, slide))
        .agg(
            F.sum("items").alias("items"),
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("accounts"),
        )
    )
    return counted.where(
        (F.col("items") >= rule.minimum_items)
        & (F.col("accounts") >= F.lit(SKETCH_SLACK * rule.minimum_accounts))
    ).select(
        *SCOPE,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "items",
        "accounts",
    )


def hourly_z(stream: DataFrame, profile: DataFrame, delay: str) -> DataFrame:
    """Closed hours per source, scored against a stored weekly profile."""
    hours = (
        stream.withWatermark("posted_at", delay)
        .groupBy("source_id", F.window("posted_at", "1 hour"))
        .agg(F.count("*").alias("items"))
        .select("source_id", F.col("window.start").alias("hour"), "items")
    )
    return baseline.z_scores(hours, profile)


def first_sightings(stream: DataFrame, delay: str) -> DataFrame:
    """Each item once, however often it is delivered within the watermark."""
    return stream.withWatermark("posted_at", delay).dropDuplicatesWithinWatermark(["content_id"])
