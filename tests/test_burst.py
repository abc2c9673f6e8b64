"""Burst windows: the truth table, a plain greedy loop, and very long busy stretches."""

import random
from datetime import datetime, timedelta

import pytest

from murmur.operators import burst

BASE = datetime(2026, 8, 4, 9, 12)
SCHEMA = (
    "tenant_id string, project_id string, source_id string, content_id string, "
    "account_id string, capture_id string, last_capture_id string, posted_at timestamp, "
    "timestamp_precision string"
)


def frame(spark, rows, precision="second"):
    """rows: (project, seconds, account)."""
    data = [
        ("t", p, "s", f"c{i}", a, f"cap{i % 3}", None, BASE + timedelta(seconds=s), precision)
        for i, (p, s, a) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def greedy(rows, w, n, m):
    out = set()
    for project in {r[0] for r in rows}:
        items = sorted((s, a) for p, s, a in rows if p == project)
        i = 0
        while i < len(items):
            inside = [x for x in items[i:] if x[0] - items[i][0] <= w]
            people = {a for _, a in inside}
            if len(inside) >= n and len(people) >= m:
                out.add((project, items[i][0], inside[-1][0], len(inside), len(people)))
                i += len(inside)
            else:
                i += 1
    return out


def run(spark, rows, w=120, n=4, m=3):
    rules = [burst.BurstRule(window_seconds=w, minimum_items=n, minimum_accounts=m)]
    got = burst.detect(frame(spark, rows), rules).collect()
    secs = lambda ts: round((ts - BASE).total_seconds(), 6)
    return {
        (r.project_id, secs(r.window_start), secs(r.window_end), r.item_count, r.account_count)
        for r in got
    }


TABLE = [
    ("tight burst", [0, 12, 24, 36, 48], 5, 1, 5),
    ("one busy account", list(range(0, 50, 5)), 1, 0, 0),
    ("spread over hours", [0, 3600, 7200, 10800, 14400], 5, 0, 0),
    ("too few accounts", list(range(0, 40, 5)), 2, 0, 0),
    ("later outlier", [0, 10, 20, 30, 20000], 5, 1, 4),
    ("inclusive edge", [0, 40, 80, 120], 4, 1, 4),
]


def test_truth_table(spark):
    rows = [
        (name, s, f"a{i % accounts}")
        for name, offsets, accounts, _, _ in TABLE
        for i, s in enumerate(offsets)
    ]
    got = run(spark, rows)
    for name, _, _, count, items in TABLE:
        mine = [g for g in got if g[0] == name]
        assert len(mine) == count, name
        assert all(g[3] == items for g in mine), name


def test_empty(spark):
    assert burst.detect(frame(spark, []).limit(0)).count() == 0


def test_matches_plain_loop_with_ties(spark):
    rng = random.Random(7)
    rows = []
    for p in range(40):
        span = rng.choice([400, 3000, 40000])
        for _ in range(rng.randint(5, 150)):
            rows.append((f"p{p}", rng.randint(0, span), f"a{rng.randint(0, rng.choice([3, 20]))}"))
    assert run(spark, rows) == greedy(rows, 120, 4, 3)
    assert run(spark, rows, 10, 2, 2) == greedy(rows, 10, 2, 2)


def test_long_busy_stretch_crosses_slots(spark):
    """No gap anywhere: the choice in each slot depends on the one before it."""
    rng = random.Random(3)
    regular = [("even", s * 7, f"a{s % 5}") for s in range(6000)]
    noisy = [("noisy", rng.randint(0, 30000), f"a{rng.randint(0, 9)}") for _ in range(5000)]
    rows = regular + noisy
    assert run(spark, rows, 30, 3, 3) == greedy(rows, 30, 3, 3)


def test_three_signals_and_membership(spark):
    obs = frame(spark, [("p", 0, "a"), ("p", 10, "b"), ("p", 20, "c"), ("p", 30, "a")])
    starts = burst.burst_starts(obs)
    inside = burst.members(obs, starts)
    (found,) = burst.findings(inside).collect()
    assert [s.name for s in found.signals] == [
        "item_count", "distinct_accounts", "window_span_seconds",
    ]
    assert [s.observed for s in found.signals] == [4.0, 3.0, 30.0]
    assert all(s.passed for s in found.signals)
    accounts = {r.account_id: r.item_count for r in burst.finding_accounts(inside).collect()}
    assert accounts == {"a": 2, "b": 1, "c": 1}


@pytest.mark.parametrize(("window", "ok"), [(60, False), (119, False), (120, True), (300, True)])
def test_minute_precision_guard(spark, window, ok):
    obs = frame(spark, [("p", 0, "a")], precision="minute")
    rules = [burst.BurstRule(window_seconds=window)]
    if ok:
        burst.require_precision(obs, rules)
    else:
        with pytest.raises(burst.RuleConfigurationError, match="too narrow"):
            burst.require_precision(obs, rules)


def test_detection_input_has_no_text(spark):
    content = frame(spark, [("p", 0, "a")]).selectExpr(
        "*", "'words' as text", "'latin' as script", "cast(null as timestamp) as deleted_at"
    )
    assert set(burst.observations(content).columns) <= set(burst.OBSERVATION_COLUMNS)
    assert not {"text", "lang", "script"} & set(burst.OBSERVATION_COLUMNS)


def test_two_rules_in_one_pass(spark):
    rows = [("p", s, f"a{i}") for i, s in enumerate([0, 10, 20, 30, 200, 260])]
    rules = [
        burst.BurstRule("r1"),
        burst.BurstRule("r2", window_seconds=300, minimum_items=6, minimum_accounts=6),
    ]
    got = burst.detect(frame(spark, rows), rules).groupBy("rule_id").count().collect()
    assert {r.rule_id: r["count"] for r in got} == {"r1": 1, "r2": 1}


def test_carried_cover_skips_the_start(spark):
    rows = [("p", s, f"a{i}") for i, s in enumerate([0, 10, 20, 30, 40, 50, 60, 70])]
    obs = frame(spark, rows)
    cover = spark.createDataFrame(
        [("t", "p", "burst", int(BASE.timestamp() * 1e6) + 30_000_000)],
        "tenant_id string, project_id string, rule_id string, covered_until long",
    )
    starts = burst.burst_starts(obs, covered=cover).collect()
    assert [(s.at - int(BASE.timestamp() * 1e6)) // 10**6 for s in starts] == [40]


def test_detection_refuses_coarse_times(spark):
    base = datetime(2026, 8, 4)
    obs = spark.createDataFrame(
        [("t", "p", "s", f"c{i}", f"a{i}", f"k{i}", base, "day") for i in range(5)],
        "tenant_id string, project_id string, source_id string, content_id string, account_id string, "
        "capture_id string, posted_at timestamp, timestamp_precision string",
    )
    with pytest.raises(Exception, match="too narrow for timestamps that step by 86400s"):
        burst.detect(obs, [burst.BurstRule()]).count()
    assert burst.detect(obs, [burst.BurstRule(window_seconds=200_000)]).count() == 1
