"""Table accessors: tenant scope, published views, month partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The months content is expected in; rows outside mean maintenance is behind.
FIRST_MONTH = "2024-01-01"
END_MONTH = "2028-01-01"


def for_tenant(table: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of one tenant. No tenant set means no rows, never all rows."""
    if tenant is None:
        return table.where(F.lit(False))
    return table.where(F.col("tenant_id") == tenant)


def for_project(table: DataFrame, project: str) -> DataFrame:
    """Rows of one project. There is no value that means every project."""
    if not project:
        raise ValueError("a project is required")
    return table.where(F.col("project_id") == project)


def live(table: DataFrame) -> DataFrame:
    return table.where(F.col("deleted_at").isNull())


def content_for_detection(content: DataFrame) -> DataFrame:
    """Behaviour only; no text, language or script."""
    return live(content).select(
        "tenant_id", "source_id", "content_id", "account_id", "capture_id", "last_capture_id",
        "posted_at", "timestamp_precision",
    )


def content_provenance(content: DataFrame) -> DataFrame:
    """Ids, traces and versions; no content."""
    return content.select(
        "tenant_id", "content_id", "capture_id", "last_capture_id", "trace_id", "last_trace_id",
        "extractor_version",
    )


def accounts_for_export(accounts: DataFrame) -> DataFrame:
    """Identity without the display name."""
    return accounts.select("tenant_id", "account_id", "platform", "handle")


def active_users(users: DataFrame) -> DataFrame:
    """Enabled users, without credentials."""
    return users.where(F.col("disabled_at").isNull()).select("user_id", "tenant_id", "email")


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def write_by_month(table: DataFrame, path: str, ts: str = "posted_at") -> None:
    """Replace the touched months only.

    Rows are not forced into one task per month: a busy month keeps as many files as it had
    tasks.
    """
    (
        table.withColumn("posted_month", month_of(F.col(ts)))
        .write.partitionBy("posted_month")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def month_counts(table: DataFrame, ts: str = "posted_at") -> DataFrame:
    return table.groupBy(month_of(F.col(ts)).alias("posted_month")).agg(
        F.count("*").alias("items")
    )


def out_of_range(
    table: DataFrame, ts: str = "posted_at", first: str = FIRST_MONTH, end: str = END_MONTH
) -> DataFrame:
    """How many rows fall outside the known months."""
    moment = F.col(ts)
    outside = (moment < F.lit(first).cast("timestamp")) | (moment >= F.lit(end).cast("timestamp"))
    return table.agg(
        F.count_if(outside).alias("outside"), F.count("*").alias("total")
    )
