"""Captured documents to typed posts, with the reasons for what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import ids, moments, text
from murmur.sources.markup import MARKER_PREFIX, POSTS_TAG, read_rows

# Fixed value: stamped on every row, compared when captures are read again.
EXTRACTOR_VERSION = 2

CAPTURE_KEYS = ["tenant_id", "source_id", "capture_id", "trace_id"]


def shape_rows(rows: DataFrame, platform: Column) -> DataFrame:
    """Raw strings to typed columns, plus ``problem`` for rows that cannot be used.

    The time, precision and script rules are the same for every platform.
    """
    posted_at = moments.parse_iso(F.col("posted_at_raw"))
    raw = rows.withColumn("platform", platform).withColumn("posted_at", posted_at)
    channel = F.col("platform") == "telegram"
    tidy = F.when(channel, text.collapse_inline(F.col("text"))).otherwise(F.col("text"))
    problem = F.when(
        (F.coalesce("external_id", F.lit("")) == "") | (F.coalesce("author", F.lit("")) == ""),
        F.concat(F.lit("missing id or author: "), F.coalesce("external_id", F.lit(""))),
    ).when(
        F.col("posted_at").isNull(),
        F.concat(
            F.lit("unreadable time in "), F.col("external_id"), F.lit(": "),
            F.coalesce("posted_at_raw", F.lit("")),
        ),
    )
    name = F.when(channel, text.collapse_inline(F.col("display_name"))).otherwise(
        F.col("display_name")
    )
    passed_through = [c for c in rows.columns if c not in (
        "external_id", "author", "display_name", "text", "posted_at_raw")]
    return raw.select(
        *passed_through,
        "platform",
        "external_id",
        F.col("author").alias("author_handle"),
        F.nullif(name, F.lit("")).alias("author_display_name"),
        text.collapse_whitespace(tidy).alias("text"),
        text.script_of(tidy).alias("script"),
        "posted_at_raw",
        "posted_at",
        moments.timestamp_precision(F.col("posted_at_raw")).alias("timestamp_precision"),
        problem.alias("problem"),
    )


def accepted(shaped: DataFrame) -> DataFrame:
    return shaped.where(F.col("problem").isNull()).drop("problem")


def quarantined(shaped: DataFrame) -> DataFrame:
    return shaped.where(F.col("problem").isNotNull())


def validate_captures(
    captures: DataFrame, shaped: DataFrame, keys: list[str], minimum: int = 1
) -> DataFrame:
    """One run row per capture: items, quarantined rows, whether the page still looks right.

    ``captures`` has the keys and, if known, ``was_utf8``.
    """
    counted = shaped.groupBy(*keys).agg(
        F.count_if(F.col("problem").isNull()).alias("items"),
        F.count_if(F.col("problem").isNotNull()).alias("rejected"),
    )
    base = captures if "was_utf8" in captures.columns else captures.withColumn(
        "was_utf8", F.lit(True)
    )
    joined = base.select(*keys, "was_utf8").join(counted, keys, "left").select(
        *keys,
        "was_utf8",
        F.coalesce("items", F.lit(0)).alias("items"),
        F.coalesce("rejected", F.lit(0)).alias("rejected"),
    )
    too_few = F.col("items") < minimum
    problems = F.array_compact(
        F.array(
            F.when(~F.col("was_utf8"), F.lit("not valid UTF-8; decoded with replacement")),
            F.when(
                F.col("rejected") > 0,
                F.concat(F.col("rejected").cast("string"), F.lit(" rows rejected")),
            ),
            F.when(
                too_few,
                F.concat(
                    F.lit("extracted "), F.col("items").cast("string"),
                    F.lit(f" items, expected at least {minimum}"),
                ),
            ),
        )
    )
    return joined.select(
        *keys,
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
        "items",
        "rejected",
        problems.alias("problems"),
        (F.size(problems) == 0).alias("validation_passed"),
    )


def identify(shaped: DataFrame) -> DataFrame:
    """Add the derived identifiers, the digest and the version."""
    return shaped.select(
        "*",
        ids.account_id(F.col("platform"), F.col("author_handle")).alias("account_id"),
        ids.content_id(F.col("platform"), F.col("external_id")).alias("content_id"),
        text.text_digest(F.col("text")).alias("text_sha256"),
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
    )


def extract(
    captures: DataFrame,
    keys: list[str] | None = None,
    tag: str = POSTS_TAG,
    prefix: str = MARKER_PREFIX,
) -> DataFrame:
    """Captures (keys, platform, body binary) to shaped rows, good and bad."""
    names = [*(keys or CAPTURE_KEYS), "platform_key"]
    tagged = captures.withColumn("platform_key", F.col("platform"))
    rows = read_rows(tagged, names, tag, prefix)
    return shape_rows(rows, F.col("platform_key")).drop("platform_key")


def content_rows(shaped: DataFrame) -> DataFrame:
    """Accepted rows as content records, ready to merge."""
    return identify(accepted(shaped))
