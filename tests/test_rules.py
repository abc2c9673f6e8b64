"""Rules in a table, and counts of broken invariants."""

import pytest

from murmur.functions import addresses
from murmur.operators import burst, quality, rules
from pyspark.sql import functions as F
from tests.test_burst import frame

SCHEMA = (
    "rule_id string, tenant_id string, name string, description string, params string, "
    "shadow_mode boolean, enabled boolean, measured_precision double"
)
GOOD = '{"window_seconds": 60, "minimum_items": 4, "minimum_accounts": 3}'
WIDE = '{"window_seconds": 300, "minimum_items": 6, "minimum_accounts": 2, "other": [1]}'


def held(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_registered_in_shadow_once_and_held_rules_stay(spark):
    table = held(spark, ("a", "t", "first", "d", GOOD, False, True, 0.9))
    offered = spark.createDataFrame(
        [("a", "t", "changed", "d", WIDE), ("b", "t", "second", None, WIDE),
         ("b", "t", "second", None, WIDE), (None, "t", "nobody", "d", GOOD)],
        "rule_id string, tenant_id string, name string, description string, params string",
    )
    once = rules.registered(table, offered)
    got = {r.rule_id: r for r in once.collect()}
    assert set(got) == {"a", "b"} and once.count() == 2
    assert (got["a"].name, got["a"].enabled, got["a"].measured_precision) == ("first", True, 0.9)
    assert (got["b"].shadow_mode, got["b"].enabled, got["b"].measured_precision) == (True, False, None)
    assert sorted(map(str, rules.registered(once, offered).collect())) == sorted(map(str, once.collect()))
    assert rules.registered(table.limit(0), offered).count() == 2
    assert quality.violations(once.withColumnRenamed("shadow_mode", "shadow"), "rules", ["rule_id"]).count() == 0


def test_listed_by_name_for_one_tenant(spark):
    table = held(
        spark, ("2", "t", "b", "", GOOD, True, False, None), ("1", "t", "b", "", GOOD, True, False, None),
        ("3", "t", "a", "", GOOD, True, False, None), ("4", "u", "a", "", GOOD, True, False, None),
    )
    assert [r.rule_id for r in rules.listed(table, "t").collect()] == ["3", "1", "2"]
    assert rules.listed(table, "nobody").count() == 0


def test_detection_by_the_table_is_detection_by_the_rules(spark):
    table = held(
        spark, ("near", "t", "near", "", GOOD, True, False, None),
        ("wide", "t", "wide", "", WIDE, True, False, None),
        ("else", "u", "else", "", GOOD, True, False, None),
    )
    obs = frame(spark, [("p", s * 7, f"a{s % 4}") for s in range(120)])
    same = [burst.BurstRule("near", "near", 60, 4, 3), burst.BurstRule("wide", "wide", 300, 6, 2)]
    assert rules.runnable(table, "t") == [
        burst.BurstRule("near", "near", 60, 4, 3, True, False),
        burst.BurstRule("wide", "wide", 300, 6, 2, True, False),
    ]
    got = sorted(map(str, rules.detect(obs, table, "t").collect()))
    assert got == sorted(map(str, burst.detect(obs, same).collect())) and got
    assert rules.detect(obs, table, "u").count() == 0
    assert rules.detect(obs, table.limit(0), "t").count() == 0


@pytest.mark.parametrize(
    "params", [None, "", "no json", "{}", '{"window_seconds": 60, "minimum_items": 0, "minimum_accounts": 3}']
)
def test_a_rule_that_cannot_measure_is_refused(spark, params):
    table = held(spark, ("r", "t", "r", "", params, True, False, None))
    with pytest.raises(burst.RuleConfigurationError, match="rule r lacks"):
        rules.runnable(table, "t")


def test_counts_of_broken_rules(spark):
    rows = spark.createDataFrame(
        [(True, True, None), (True, False, 1.5), (False, True, None), (None, None, None)],
        "enabled boolean, shadow boolean, measured_precision double",
    )
    assert {r.rule: r.rows for r in quality.counted(rows, "rules").collect()} == {
        "precision_required_to_enable": 1, "precision_is_a_proportion": 1, "enabled_is_not_shadow": 1,
    }
    assert quality.counted(rows.limit(0), "rules").count() == 0


def test_every_platform_has_a_note(spark):
    assert addresses.PLATFORM_NOTES.keys() == addresses.PLATFORM_SUPPORT.keys()
    keys = spark.createDataFrame([(k,) for k in [*addresses.PLATFORM_NOTES, "forum", None]], "k string")
    got = {r.k: r.n for r in keys.select("k", addresses.platform_note(F.col("k")).alias("n")).collect()}
    assert got == addresses.PLATFORM_NOTES | {"forum": None, None: None}
