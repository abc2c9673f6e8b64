"""Content and account history: upserts, re-observation, reprocessing, retention.

There is no table format with MERGE here. Stored tables are snapshots by month
(:mod:`murmur.sources.snapshots`): a merge reads the months its batch touches, joins the
folded batch to them and publishes their new folders with one commit. Frames that are not
stored are merged as a union folded per key with ``min_by``/``max_by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.extract import EXTRACTOR_VERSION
from murmur.sources import snapshots

#: Ids carry no tenant, so two tenants may hold the same public item.
CONTENT_KEY = ["tenant_id", "content_id", "posted_at"]
FIRST_ONLY = [
    "source_id", "account_id", "capture_id", "trace_id", "posted_at_raw",
    "timestamp_precision", "text", "text_sha256", "extractor_version", "script",
]
LATEST = ["last_seen", "last_capture_id", "last_trace_id"]


def merge_accounts(stored: DataFrame | None, seen: DataFrame) -> DataFrame:
    """Insert new accounts; for known ones only ``last_seen`` moves.

    ``seen`` has account_id, tenant_id, platform, handle, display_name, seen_at and ``seq``,
    the processing order. ``last_seen`` is that of the last processed sighting, which need
    not be the largest.
    """
    key = ["tenant_id", "account_id"]
    first = ["platform", "handle", "display_name", "first_seen"]
    new = seen.select(
        "account_id", "tenant_id", "platform", "handle", "display_name",
        F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"),
        F.lit(1).alias("era"), "seq",
    )
    rows = new
    if stored is not None:
        order = seen.schema["seq"].dataType
        rows = new.unionByName(
            stored.select(*key, *first, "last_seen").withColumn("era", F.lit(0))
            .withColumn("seq", F.lit(None).cast(order))
        )
    order = F.struct("era", "seq")
    return rows.groupBy(*key).agg(
        F.min_by(F.struct(*first), order).alias("f"),
        F.max_by("last_seen", order).alias("last_seen"),
    ).select(*key, "f.*", "last_seen")


def merge_content(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Insert new items; a repeat moves ``last_*`` and nothing else.

    ``batch`` has the content columns plus ``seen_at`` and ``seq`` (processing order).
    """
    first = [c for c in FIRST_ONLY if c in batch.columns]
    new = batch.select(
        *CONTENT_KEY, *first,
        F.col("seen_at").alias("first_seen"),
        F.col("seen_at").alias("last_seen"),
        F.col("capture_id").alias("last_capture_id"),
        F.col("trace_id").alias("last_trace_id"),
        F.lit(1).alias("era"), "seq",
    )
    rows = new
    if stored is not None:
        seq_type = batch.schema["seq"].dataType
        rows = new.unionByName(
            stored.select(*CONTENT_KEY, *first, "first_seen", *LATEST)
            .withColumn("era", F.lit(0))
            .withColumn("seq", F.lit(None).cast(seq_type))
        )
    order = F.struct("era", "seq")
    return rows.groupBy(*CONTENT_KEY).agg(
        F.min_by(F.struct(*first, "first_seen"), order).alias("f"),
        F.max_by(F.struct(*LATEST), order).alias("l"),
    ).select(*CONTENT_KEY, "f.*", "l.*")


def fold_content(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """:func:`merge_content` by joins: the batch is folded first, stored rows are not shuffled for it.

    Stored rows take ``last_*`` from the batch where it has them again; what is not stored is
    added. Adaptive execution broadcasts a small batch, so stored rows stay where they are
    read; against them only keys are compared.
    """
    new = merge_content(None, batch)
    if stored is None:
        return new
    again = new.select(*CONTENT_KEY, F.struct(*LATEST).alias("again"))
    moved = stored.join(again, CONTENT_KEY, "left").select(
        *[
            F.coalesce(F.col(f"again.{c}"), F.col(c)).alias(c) if c in LATEST else F.col(c)
            for c in stored.columns
        ]
    )
    fresh = new.join(stored.select(*CONTENT_KEY), CONTENT_KEY, "left_anti")
    return moved.unionByName(fresh, allowMissingColumns=True)


def fold_accounts(stored: DataFrame | None, seen: DataFrame) -> DataFrame:
    """:func:`merge_accounts` by joins, as :func:`fold_content`."""
    new = merge_accounts(None, seen)
    if stored is None:
        return new
    key = ["tenant_id", "account_id"]
    again = new.select(*key, F.col("last_seen").alias("again"))
    moved = stored.join(again, key, "left").withColumn("last_seen", F.coalesce("again", "last_seen")).drop("again")
    return moved.unionByName(new.join(stored.select(*key), key, "left_anti"))


def merge_stored_content(store: snapshots.Store, batch: DataFrame, number: int) -> int:
    """Merge a batch into the stored months it touches; batch ``number`` is applied once."""
    return store.merge("content", batch, snapshots.month(), fold_content, "content", number)


def merge_stored_accounts(store: snapshots.Store, seen: DataFrame, number: int) -> int:
    """The same for accounts, which are stored by buckets of their key."""
    return store.merge("accounts", seen, snapshots.bucket("tenant_id", "account_id"), fold_accounts, "accounts", number)


def reprocess_stored(store: snapshots.Store, outcomes: DataFrame, number: int) -> int:
    """Write newer readings into the stored months that have any."""
    updated = outcomes.where(F.col("outcome") == "updated")
    return store.merge("content", updated, snapshots.month(), apply_reprocessing, "reprocessing", number)


def reprocessing_backlog(
    content: DataFrame, sources: DataFrame, version: int = EXTRACTOR_VERSION
) -> DataFrame:
    """Captures whose oldest live item predates the extractor.

    Counted per capture before the join to sources, so the join sees captures, not items.
    """
    live = content.where(F.col("deleted_at").isNull())
    per_capture = live.groupBy("tenant_id", "last_capture_id", "source_id").agg(
        F.min("extractor_version").alias("v"), F.count("*").alias("n")
    )
    return (
        per_capture.join(sources.select("source_id", "platform"), "source_id")
        .groupBy("tenant_id", F.col("last_capture_id").alias("capture_id"), "platform")
        .agg(F.min("v").alias("oldest_extractor_version"), F.sum("n").alias("items"))
        .where(F.col("oldest_extractor_version") < version)
    )


def reprocess_outcomes(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Each re-read item against what is stored for the same capture.

    ``parsed`` has tenant_id, capture_id, content_id, posted_at, text, text_sha256, script,
    timestamp_precision and extractor_version. Outcomes: unknown, needs_migration, updated,
    unchanged. An item that its capture lists more than once (column ``ordinal``, if there is
    one, tells the order) is updated by its first reading; the others find it up to date.
    """
    old = stored.where(F.col("deleted_at").isNull()).select(
        "tenant_id",
        F.col("last_capture_id").alias("capture_id"),
        "content_id",
        F.col("posted_at").alias("stored_posted_at"),
        F.col("extractor_version").alias("stored_version"),
    )
    outcome = (
        F.when(F.col("stored_version").isNull(), F.lit("unknown"))
        .when(F.col("stored_posted_at") != F.col("posted_at"), F.lit("needs_migration"))
        .when(F.col("stored_version") < F.col("extractor_version"), F.lit("updated"))
        .otherwise(F.lit("unchanged"))
    )
    found = _numbered(parsed).join(old, ["tenant_id", "capture_id", "content_id"], "left")
    found = found.withColumn("outcome", outcome)
    later = (F.col("outcome") == "updated") & (F.col("reading") > 1)
    return found.withColumn("outcome", F.when(later, F.lit("unchanged")).otherwise(F.col("outcome")))


def _numbered(parsed: DataFrame) -> DataFrame:
    """``reading`` 1, 2, 3 ... of an item that its capture lists more than once, else 1.

    Their order is that of the list (``ordinal``), else of a digest of what they say. Only
    keys are counted and only those of repeated items are sorted; no text is.
    """
    item = ["tenant_id", "capture_id", "content_id", "posted_at"]
    rows = parsed
    if "ordinal" not in parsed.columns:
        rows = parsed.withColumn("ordinal", F.xxhash64(*[c for c in parsed.columns if c not in ("text", *item)]))
    keys = rows.groupBy(*item, "ordinal").agg(F.count("*").alias("copies"))
    repeated = rows.groupBy(*item).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    turn = F.sum("copies").over(Window.partitionBy(*item).orderBy("ordinal")) - F.col("copies") + 1
    turns = keys.join(repeated, item, "left_semi").withColumn("reading", turn).drop("copies")
    return rows.join(turns, [*item, "ordinal"], "left").withColumn("reading", F.coalesce("reading", F.lit(1))).select(
        *parsed.columns, "reading"
    )


def apply_reprocessing(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Write the newer reading over the older one; identity columns stay."""
    changed = ["text", "text_sha256", "script", "timestamp_precision", "extractor_version"]
    new = (
        outcomes.where(F.col("outcome") == "updated")
        .groupBy(*CONTENT_KEY)
        .agg(F.min_by(F.struct(*changed), F.struct("capture_id", "reading")).alias("new"))
    )
    joined = stored.join(new, CONTENT_KEY, "left")
    return joined.select(
        *[
            F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
            if c in changed
            else F.col(c)
            for c in stored.columns
        ]
    )


def reprocess_report(backlog: DataFrame, documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per tenant. ``documents`` has tenant_id, capture_id and ``document``."""
    captures = (
        backlog.join(documents, ["tenant_id", "capture_id"], "left")
        .groupBy("tenant_id")
        .agg(
            F.count("*").alias("captures_examined"),
            F.count_if(F.col("document").isNotNull()).alias("captures_reprocessed"),
            F.count_if(F.col("document").isNull()).alias("captures_unavailable"),
        )
    )

    def count_of(name: str) -> Column:
        return F.count_if(F.col("outcome") == name)

    items = outcomes.groupBy("tenant_id").agg(
        count_of("updated").alias("items_updated"),
        count_of("unchanged").alias("items_unchanged"),
        count_of("needs_migration").alias("items_needing_migration"),
    )
    zero = F.lit(0).cast("long")
    return captures.join(items, "tenant_id", "left").select(
        "tenant_id",
        "captures_examined",
        "captures_reprocessed",
        "captures_unavailable",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("items_updated", "items_unchanged", "items_needing_migration")
        ],
        zero.alias("fetches_performed"),
    )


def backfill_last(content: DataFrame) -> DataFrame:
    """Rows written before the ``last_*`` columns existed start equal to the first ones."""
    return content.withColumns(
        {
            "last_seen": F.coalesce("last_seen", "first_seen"),
            "last_capture_id": F.coalesce("last_capture_id", "capture_id"),
            "last_trace_id": F.coalesce("last_trace_id", "trace_id"),
        }
    )


def backfill_project(table: DataFrame, default: str) -> DataFrame:
    return table.withColumn("project_id", F.coalesce("project_id", F.lit(default)))


def expired(table: DataFrame, tenants: DataFrame, now: Column, ts: str = "captured_at"):
    """Rows past their tenant's retention (1 to 3650 days)."""
    limits = tenants.select("tenant_id", "retention_days")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return (
        table.join(limits, "tenant_id")
        .where(age > F.col("retention_days").cast("long") * 86_400_000_000)
        .drop("retention_days")
    )


def recent(content: DataFrame, accounts: DataFrame, limit: int = 100) -> DataFrame:
    """Newest live items with their author; the id breaks ties.

    Every item has an account (see :func:`murmur.operators.quality.orphans`), so the top rows
    are taken first and only they meet the accounts; an item without one keeps null names.
    """
    key = ["tenant_id", "account_id"]
    newest = (
        content.where(F.col("deleted_at").isNull())
        .orderBy(F.desc("posted_at"), F.desc("content_id"))
        .limit(limit)
    )
    return newest.join(accounts.select(*key, "handle", "display_name"), key, "left")


def counts(content: DataFrame, accounts: DataFrame) -> DataFrame:
    """(content, accounts) per tenant."""
    a = content.groupBy("tenant_id").agg(F.count("*").alias("content"))
    b = accounts.groupBy("tenant_id").agg(F.count("*").alias("accounts"))
    zero = F.lit(0).cast("long")
    return a.join(b, "tenant_id", "full").select(
        "tenant_id", F.coalesce("content", zero).alias("content"),
        F.coalesce("accounts", zero).alias("accounts"),
    )
