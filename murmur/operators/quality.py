"""Table invariants as rules, uniqueness and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The invariants of each table, as SQL conditions. Null passes, as in a CHECK.
RULES: dict[str, dict[str, str]] = {
    "sources": {
        "priority_range": "priority between 1 and 10",
        "interval_sane": "interval_seconds >= 60",
        "url_is_http": "url rlike '^https?://'",
    },
    "captures": {
        "bytes_non_negative": "bytes_transferred >= 0",
        "completed_after_requested": "completed_at is null or completed_at >= requested_at",
        "status_known": "status in ('pending','succeeded','failed_network','failed_timeout',"
        "'failed_blocked','failed_not_found','failed_internal','not_configured')",
    },
    "hash_chain": {
        "index_non_negative": "chain_index >= 0",
        "hashes_lower_hex": "prev_hash rlike '^[0-9a-f]{64}$' and "
        "manifest_sha256 rlike '^[0-9a-f]{64}$' and entry_hash rlike '^[0-9a-f]{64}$'",
        "genesis_is_index_zero": "(chain_index = 0) = (prev_hash = repeat('0', 64))",
    },
    "rules": {
        "precision_required_to_enable": "not enabled or measured_precision is not null",
        "precision_is_a_proportion": "measured_precision is null or "
        "measured_precision between 0 and 1",
        "enabled_is_not_shadow": "not (enabled and shadow)",
    },
    "findings": {
        "evidence_required": "size(evidence_refs) >= 1",
        "signals_minimum": "size(signals) >= 3",
        "window_ordered": "window_end >= window_start",
        "counts_positive": "item_count > 0 and account_count > 0",
    },
    "scheduler_runs": {
        "outcome_known": "outcome in ('ok', 'idle', 'failed')",
        "counts_non_negative": "sources_due >= 0 and captures >= 0 and items >= 0 and "
        "findings >= 0 and exports >= 0 and held_for_review >= 0",
        "ordered": "finished_at is null or finished_at >= started_at",
    },
    "grants": {
        "expires_later": "expires_at > created_at",
        "short": "expires_at <= created_at + interval 12 hours",
        "justified": "length(trim(justification)) >= 20",
        "grants_something": "size(permissions) > 0",
        "not_self": "granted_to <> granted_by",
    },
    "content": {
        "precision_known": "timestamp_precision in ('second','minute','hour','day')",
    },
    "verdicts": {
        "state_known": "verdict in ({verdicts})",
        "analyst_named": "length(analyst) > 0",
    },
}


def rules_for(table: str) -> dict[str, str]:
    from murmur.operators.review import VERDICTS

    listed = ", ".join(f"'{v}'" for v in VERDICTS)
    return {name: rule.replace("{verdicts}", listed) for name, rule in RULES[table].items()}


def violations(rows: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Rows that break a rule, with the names of the rules. One narrow pass."""
    broken = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(name))
                for name, rule in rules_for(table).items()
            ]
        )
    )
    return rows.select(*keys, broken.alias("violated")).where(F.size("violated") > 0)


def counted(rows: DataFrame, table: str) -> DataFrame:
    """How many rows break each rule; a rule that holds everywhere has no row."""
    broken = violations(rows, table, []).select(F.explode("violated").alias("rule"))
    return broken.groupBy("rule").agg(F.count("*").alias("rows"))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def orphans(rows: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose parent is missing."""
    return rows.join(parents.select(*key), key, "left_anti")
