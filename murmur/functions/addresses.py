"""Source lines, fetch outcomes and the platform register."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions.text import strip

# Spellings of a channel address and of a page host.
CHANNEL_PREFIXES = (
    "https://t.me/s/",
    "http://t.me/s/",
    "https://t.me/",
    "http://t.me/",
    "@",
)
PAGE_HOSTS = ("www.facebook.com/", "m.facebook.com/", "mbasic.facebook.com/", "facebook.com/")

# What each platform supports today.
PLATFORM_SUPPORT = {
    "canary": "extracts",
    "html": "capture_only",
    "facebook": "needs_route",
    "x": "blocked",
    "tiktok": "blocked",
    "telegram": "extracts",
}

#: What a person who adds a source is told.
PLATFORM_NOTES = {
    "canary": "A page of your own for trying out the whole path. Its posts are read.",
    "html": "Any page that opens without a login. It is kept and sealed as evidence, but no posts are "
    "read from it, so it cannot lead to a finding.",
    "facebook": "Needs a licensed route and its credentials. Sources may be added now and are collected "
    "once a route is set up; until then they wait.",
    "x": "Closed to anonymous readers. Nothing is collected.",
    "tiktok": "Built in the browser and closed to anonymous readers. Nothing is collected.",
    "telegram": "Public channels are read through their web preview, with times to the second. One channel "
    "is one author, so add several.",
}


def _literal(options: tuple[str, ...]) -> str:
    return "|".join(option.replace(".", r"\.") for option in options)


def _tail_handle(value: Column) -> Column:
    """Up to the first ``?``, then up to the first ``/``."""
    return F.regexp_replace(F.regexp_replace(value, r"(?s)\?.*", ""), r"(?s)/.*", "")


def channel_handle(value: Column) -> Column:
    return _tail_handle(F.regexp_replace(value, rf"\A(?:{_literal(CHANNEL_PREFIXES)})", ""))


def page_handle(value: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(value), r"/+\z", ""), r"\A@+", "")
    no_scheme = F.regexp_replace(bare, r"\Ahttps?://", "")
    return _tail_handle(F.regexp_replace(no_scheme, rf"\A(?:{_literal(PAGE_HOSTS)})", ""))


def normalise_source(line: Column, platform: Column) -> Column:
    """One pasted line to ``struct(name, url, reason)``; reason is null when accepted."""
    value = F.regexp_replace(
        F.regexp_replace(strip(line), r"\A[<>]+|[<>]+\z", ""), r"/+\z", ""
    )
    channel, page = channel_handle(value), page_handle(value)
    channel_ok = channel.rlike(r"\A[\p{L}\p{N}_]+\z")
    page_ok = page.rlike(r"\A[\p{L}\p{N}._-]+\z")
    http_ok = value.rlike(r"\Ahttps?://")
    reason = (
        F.when(value == "", F.lit("empty"))
        .when((platform == "telegram") & ~channel_ok, F.lit("not a channel name"))
        .when((platform == "facebook") & ~page_ok, F.lit("not a page name"))
        .when(~platform.isin("telegram", "facebook") & ~http_ok, F.lit("not an http address"))
    )
    name = (
        F.when(platform == "telegram", F.concat(F.lit("t.me/"), channel))
        .when(platform == "facebook", F.concat(F.lit("facebook.com/"), page))
        .otherwise(F.substring(F.regexp_replace(value, r"(?s)\A.*?//", ""), 1, 60))
    )
    url = (
        F.when(platform == "telegram", F.concat(F.lit("https://t.me/s/"), channel))
        .when(platform == "facebook", F.concat(F.lit("https://www.facebook.com/"), page))
        .otherwise(value)
    )
    return F.struct(
        F.when(reason.isNull(), name).alias("name"),
        F.when(reason.isNull(), url).alias("url"),
        reason.alias("reason"),
    )


def fetch_outcome(
    http_status: Column, error: Column, size: Column, cap: int = 8 * 1024 * 1024
) -> Column:
    """Class of a logged attempt: ``succeeded`` or one of five ``failed_`` kinds."""
    return (
        F.when(error == "timeout", F.lit("failed_timeout"))
        .when(error == "connection", F.lit("failed_network"))
        .when(error.isNotNull(), F.lit("failed_internal"))
        .when(http_status == 404, F.lit("failed_not_found"))
        .when(http_status.isin(401, 403, 429), F.lit("failed_blocked"))
        .when(http_status >= 400, F.lit("failed_network"))
        .when(size > cap, F.lit("failed_internal"))
        .otherwise(F.lit("succeeded"))
    )


def platform_support(platform: Column) -> Column:
    """Support status of a platform key; a key nobody registered is ``unknown``.

    Six fixed entries, so a ``CASE`` does what a join to a tiny table would.
    """
    out = F.lit("unknown")
    for key, support in PLATFORM_SUPPORT.items():
        out = F.when(platform == key, F.lit(support)).otherwise(out)
    return out


def platform_note(platform: Column) -> Column:
    """The note of a platform key; null for a key nobody registered."""
    out = F.lit(None).cast("string")
    for key, note in PLATFORM_NOTES.items():
        out = F.when(platform == key, F.lit(note)).otherwise(out)
    return out
