"""Writers of results that belong together. Each adds rows and never changes old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import ids
from murmur.operators import burst
from murmur.session import materialise
from murmur.sources.snapshots import State, Store

FINDING_TABLES = ("findings", "finding_accounts", "finding_captures")


def membership(obs: DataFrame, rules: list[burst.BurstRule]) -> DataFrame:
    """The items of all windows that fire, written to the shared folder."""
    return materialise(burst.members(obs, burst.burst_starts(obs, rules), rules), "members")


def write_findings(
    obs: DataFrame, rules: list[burst.BurstRule], path: str, run_id: str,
    inside: DataFrame | None = None,
) -> None:
    """Findings with their accounts and captures, as one run of three tables.

    The membership is computed once; a further attempt may pass it as ``inside``. All three
    become current with one commit; a run that is repeated takes the place of its earlier
    attempt, and a reader in between sees that one whole.
    """
    spark = obs.sparkSession
    inside = membership(obs, rules) if inside is None else inside
    parts = {
        "finding_accounts": burst.finding_accounts(inside),
        "finding_captures": burst.finding_captures(inside),
        "findings": burst.findings(inside, rules),
    }
    run = F.lit(run_id).alias("run_id")
    Store(spark, path).put({name: rows.select("*", run) for name, rows in parts.items()}, run_id)


def read_findings(spark: SparkSession, path: str, name: str = "findings") -> DataFrame:
    """One of the three tables. Pass a :class:`State` as ``spark`` to read all three as of one commit."""
    state = spark if isinstance(spark, State) else Store(spark, path).state()
    return state.read(name)


def append_runs(runs: DataFrame, path: str, validated_at: Column, batch: str) -> None:
    """Log of extraction runs, from :func:`murmur.operators.extract.validate_captures`.

    ``batch`` names the job; a job that is repeated does not append again.
    """
    Store(runs.sparkSession, path).put({"runs": runs.withColumn("validated_at", validated_at)}, batch)


def append_exports(bundles: DataFrame, path: str, created_at: Column, batch: str) -> None:
    """Exported bundles. A new export is a new row, also for a finding exported before."""
    made = bundles.withColumn("created_at", created_at.cast("timestamp"))
    rows = made.withColumn(
        "export_id",
        ids.uuid5(
            ids.CONTENT_NAMESPACE,
            F.concat_ws("|", F.lit("export"), "finding_id", F.unix_micros("created_at").cast("string")),
        ),
    )
    Store(bundles.sparkSession, path).put({"exports": rows}, batch)
