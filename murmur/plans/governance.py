"""Rules as a table, invariants of the stored tables, and what is said about platforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import addresses
from murmur.operators import quality, rules
from murmur.plans import sample
from murmur.plans.detection import WINDOWS_SQL
from murmur.plans.registry import plain, query, table
from murmur.plans.sample import bursts_sql

_RULES = """SELECT 'rule-'||c_custkey AS rule_id, 't'||c_nationkey AS tenant_id, c_name AS name,
 c_mktsegment AS description, '{"window_seconds":'||(60 * (1 + c_custkey % 3))||'}' AS params FROM customer"""


def _rules(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("key"),
        F.concat(F.lit("rule-"), key).alias("rule_id"),
        F.concat(F.lit("t"), "c_nationkey").alias("tenant_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"),
        F.concat(F.lit('{"window_seconds":'), 60 * (1 + key % 3), F.lit("}")).alias("params"),
    )


@query(
    "rules_registered",
    f"""SELECT rule_id, tenant_id, name, description, params, CAST(substr(rule_id, 6) AS BIGINT) % 3 = 0 OR
 CAST(substr(rule_id, 6) AS BIGINT) % 2 = 1 AS shadow_mode, CAST(substr(rule_id, 6) AS BIGINT) % 3 > 0 AND
 CAST(substr(rule_id, 6) AS BIGINT) % 2 = 0 AS enabled FROM ({_RULES})""",
)
def rules_registered(spark, sf):
    """Two thirds are held, half of them enabled; all are offered, twice and with other parameters."""
    offered = _rules(spark, sf)
    held = offered.where("key % 3 > 0").withColumns(
        {"shadow_mode": F.expr("key % 2 = 1"), "enabled": F.expr("key % 2 = 0")}
    )
    changed = offered.where("key % 3 > 0").withColumn("params", F.lit("{}"))
    return rules.registered(
        held.drop("key"), offered.unionByName(offered).unionByName(changed).drop("key")
    )


@query(
    "rules_listed",
    f"SELECT rule_id, name, description, params FROM ({_RULES}) WHERE tenant_id = 't3'",
)
def rules_listed(spark, sf):
    """The rules of one tenant."""
    return rules.listed(_rules(spark, sf).drop("key"), "t3")


@query(
    "burst_rules_table",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT 'rule-{k}' AS rule_id, * FROM ({bursts_sql(window=60 * (k + 1))} {WINDOWS_SQL}))"
        for k in range(3)
    ),
)
def burst_rules_table(spark, sf):
    """Bursts by the rules a tenant has in its table, in one pass."""
    key = F.col("r_regionkey")
    held = table(spark, sf, "region").select(
        F.concat(F.lit("rule-"), key).alias("rule_id"),
        F.when(key < 3, F.lit("t0")).otherwise(F.lit("t1")).alias("tenant_id"),
        F.col("r_name").alias("name"),
        F.lit(True).alias("shadow_mode"),
        F.lit(False).alias("enabled"),
        F.concat(
            F.lit('{"window_seconds":'), 60 * (key + 1),
            F.lit(',"minimum_items":4,"minimum_accounts":3}'),
        ).alias("params"),
    )
    found = rules.detect(sample.observations(spark, sf), held, "t0")
    return found.select(
        "rule_id", "project_id", plain("window_start").alias("window_start"),
        plain("window_end").alias("window_end"), "item_count", "account_count",
    )


@query(
    "invariants_counted",
    """WITH r AS (SELECT c_custkey % 2 = 0 AS en, c_custkey % 3 = 0 AS sh, CASE WHEN c_custkey % 5 > 0
 THEN c_custkey % 13 END AS tenths FROM customer),
 s AS (SELECT o_orderstatus AS st, o_orderkey % 50 - 1 AS due, CASE WHEN o_orderkey % 7 < 6 THEN
 o_orderkey % 7 - 1 END AS took FROM orders),
 g AS (SELECT c_custkey % 15 - 1 AS hours, length(trim(c_name||repeat(' ', 30))) AS words,
 c_custkey % 6 AS held, c_custkey % 4 = c_custkey % 5 AS self FROM customer),
 l AS (SELECT l_quantity - 5 AS bytes, l_linestatus AS st, l_linenumber - 2 AS took FROM lineitem),
 c(table_name, rule, bad) AS (
 SELECT 'rules', 'precision_required_to_enable', count(*) FILTER (WHERE en AND tenths IS NULL) FROM r
 UNION ALL SELECT 'rules', 'precision_is_a_proportion', count(*) FILTER (WHERE tenths > 10) FROM r
 UNION ALL SELECT 'rules', 'enabled_is_not_shadow', count(*) FILTER (WHERE en AND sh) FROM r
 UNION ALL SELECT 'scheduler_runs', 'outcome_known', count(*) FILTER (WHERE st NOT IN ('O', 'F')) FROM s
 UNION ALL SELECT 'scheduler_runs', 'counts_non_negative', count(*) FILTER (WHERE due < 0) FROM s
 UNION ALL SELECT 'scheduler_runs', 'ordered', count(*) FILTER (WHERE took < 0) FROM s
 UNION ALL SELECT 'grants', 'expires_later', count(*) FILTER (WHERE hours <= 0) FROM g
 UNION ALL SELECT 'grants', 'short', count(*) FILTER (WHERE hours > 12) FROM g
 UNION ALL SELECT 'grants', 'justified', count(*) FILTER (WHERE words < 20) FROM g
 UNION ALL SELECT 'grants', 'grants_something', count(*) FILTER (WHERE held = 0) FROM g
 UNION ALL SELECT 'grants', 'not_self', count(*) FILTER (WHERE self) FROM g
 UNION ALL SELECT 'content', 'precision_known', count(*) FILTER (WHERE doc_id % 5 = 4) FROM documents
 UNION ALL SELECT 'verdicts', 'state_known', count(*) FILTER (WHERE doc_id % 5 = 4) FROM labels
 UNION ALL SELECT 'verdicts', 'analyst_named', count(*) FILTER (WHERE doc_id % 3 = 0) FROM labels
 UNION ALL SELECT 'captures', 'bytes_non_negative', count(*) FILTER (WHERE bytes < 0) FROM l
 UNION ALL SELECT 'captures', 'completed_after_requested', count(*) FILTER (WHERE took < 0) FROM l
 UNION ALL SELECT 'captures', 'status_known', count(*) FILTER (WHERE st <> 'O') FROM l)
 SELECT table_name, rule, bad AS rows FROM c WHERE bad > 0""",
)
def invariants_counted(spark, sf):
    """How many rows of six stored tables break which of their rules."""
    moment = "timestamp_seconds(1704067200 + {})".format
    made = {
        "rules": table(spark, sf, "customer").selectExpr(
            "c_custkey % 2 = 0 AS enabled", "c_custkey % 3 = 0 AS shadow",
            "CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 13) / 10 END AS measured_precision",
        ),
        "scheduler_runs": table(spark, sf, "orders").selectExpr(
            "CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'failed' ELSE 'partial' END AS outcome",
            "o_orderkey % 50 - 1 AS sources_due",
            *[f"0 AS {c}" for c in ("captures", "items", "findings", "exports", "held_for_review")],
            f"{moment('0')} AS started_at",
            f"CASE WHEN o_orderkey % 7 < 6 THEN {moment('o_orderkey % 7 - 1')} END AS finished_at",
        ),
        "grants": table(spark, sf, "customer").selectExpr(
            f"{moment('0')} AS created_at", f"{moment('3600 * (c_custkey % 15 - 1)')} AS expires_at",
            "concat(c_name, repeat(' ', 30)) AS justification",
            "CASE WHEN c_custkey % 6 = 0 THEN array() ELSE array('export') END AS permissions",
            "concat('u', c_custkey % 4) AS granted_to", "concat('u', c_custkey % 5) AS granted_by",
        ),
        "content": table(spark, sf, "documents").selectExpr(
            "element_at(array('second', 'minute', 'hour', 'day', 'week'), int(doc_id % 5) + 1)"
            " AS timestamp_precision"
        ),
        "verdicts": table(spark, sf, "labels").selectExpr(
            "element_at(array('confirmed_coordination', 'likely_coordination', 'insufficient_evidence',"
            " 'no_coordination', 'maybe'), int(doc_id % 5) + 1) AS verdict",
            "substring('ab', 1, int(doc_id % 3)) AS analyst",
        ),
        "captures": table(spark, sf, "lineitem").selectExpr(
            "l_quantity - 5 AS bytes_transferred", f"{moment('0')} AS requested_at",
            f"{moment('l_linenumber - 2')} AS completed_at",
            "CASE l_linestatus WHEN 'O' THEN 'succeeded' ELSE 'lost' END AS status",
        ),
    }
    counted = [
        quality.counted(rows, name).select(F.lit(name).alias("table_name"), "rule", "rows")
        for name, rows in made.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query(
    "platform_notes",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{key}', '{addresses.PLATFORM_SUPPORT[key]}', '{note}')"
        for key, note in addresses.PLATFORM_NOTES.items()
    )
    + ") AS n(platform, support, note) WHERE platform IN (SELECT "
    "['canary','html','facebook','x','tiktok','telegram','forum'][page_id % 7 + 1] FROM pages)",
)
def platform_notes(spark, sf):
    """What an analyst is told about the platforms of the sources; nothing about unknown ones."""
    keys = ["canary", "html", "facebook", "x", "tiktok", "telegram", "forum"]
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("page_id") % 7 + 1).cast("int"))
    return (
        table(spark, sf, "pages").select(key.alias("platform")).distinct()
        .withColumn("support", addresses.platform_support(F.col("platform")))
        .withColumn("note", addresses.platform_note(F.col("platform")))
        .where(F.col("note").isNotNull())
    )
