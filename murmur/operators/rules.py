"""Detection rules kept in a table: registered in shadow, listed by name, read to be run.

A row has rule_id, tenant_id, name, description, ``params`` (JSON), shadow_mode, enabled and
measured_precision. A rule nobody has measured runs in shadow and is not enabled; the
invariants of the table are in :mod:`murmur.operators.quality`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import burst
from murmur.operators.burst import BurstRule, RuleConfigurationError

GIVEN = ["tenant_id", "name", "description", "params"]
PARAMS = "window_seconds long, minimum_items long, minimum_accounts long"

#: A tenant's rules are read by the driver, which plans them as constants. More is an error.
MOST = 1000


def registered(held: DataFrame, offered: DataFrame) -> DataFrame:
    """``held`` with the rules of ``offered`` whose id it does not have, in shadow and disabled.

    A rule that is held stays as it is, also where its row is offered with other parameters.
    An id offered more than once is added once, with the smallest of its rows; one without id
    is not added.
    """
    fresh = (
        offered.where(F.col("rule_id").isNotNull())
        .groupBy("rule_id")
        .agg(F.min(F.struct(*GIVEN)).alias("given"))
        .join(held.select("rule_id"), "rule_id", "left_anti")
        .select(
            "rule_id",
            *[F.col(f"given.{c}").alias(c) for c in GIVEN],
            F.lit(True).alias("shadow_mode"),
            F.lit(False).alias("enabled"),
        )
    )
    return held.unionByName(fresh, allowMissingColumns=True)


def listed(table: DataFrame, tenant: str) -> DataFrame:
    """The rules of a tenant by name, equal names by id."""
    return table.where(F.col("tenant_id") == tenant).drop("tenant_id").orderBy("name", "rule_id")


def runnable(table: DataFrame, tenant: str) -> list[BurstRule]:
    """The rules of a tenant as a detection run takes them; raises where one cannot measure."""
    rows = (
        table.where(F.col("tenant_id") == tenant)
        .select(
            "rule_id", "name", "shadow_mode", "enabled",
            F.from_json("params", PARAMS).alias("p"),
        )
        .orderBy("rule_id")
        .limit(MOST + 1)
        .collect()
    )
    if len(rows) > MOST:
        raise RuleConfigurationError(f"tenant {tenant} has more than {MOST} rules")
    for row in rows:
        given = row.p.asDict() if row.p else {}
        bad = [name for name in ("window_seconds", "minimum_items", "minimum_accounts")
               if (given.get(name) or 0) < 1]
        if bad:
            raise RuleConfigurationError(f"rule {row.rule_id} lacks a positive {', '.join(bad)}")
    return [
        BurstRule(
            row.rule_id, row.name, row.p.window_seconds, row.p.minimum_items,
            row.p.minimum_accounts, row.shadow_mode, row.enabled,
        )
        for row in rows
    ]


def detect(obs: DataFrame, table: DataFrame, tenant: str) -> DataFrame:
    """Findings of a tenant by the rules of its table, in one pass; no rules, no findings."""
    own = obs.where(F.col("tenant_id") == tenant)
    rules = runnable(table, tenant)
    return burst.detect(own, rules) if rules else burst.detect(own.where(F.lit(False)))
