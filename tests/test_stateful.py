"""Bursts in the state store and sketches of panes, against plain loops."""

import random
from datetime import timedelta

import numpy as np
import pytest

from murmur.operators.burst import BurstRule
from murmur.streaming import jobs, stateful, windows
from tests.test_burst import BASE, SCHEMA, frame, greedy

RULE = BurstRule(window_seconds=60)


def deliver(spark, tmp_path, parts, build):
    """Each part is a batch of its own; returns what the sink holds after every part."""
    held = []
    for i, rows in enumerate(parts):
        frame(spark, rows).write.parquet(f"{tmp_path}/in/part={i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/part=*")
        stateful.with_state_store(
            spark,
            lambda: jobs.run_to_files(build(stream), f"{tmp_path}/out", f"{tmp_path}/ck"),
        )
        held.append(spark.read.parquet(f"{tmp_path}/out").collect())
    return held


def found(rows):
    secs = lambda ts: (ts - BASE).total_seconds()
    return {(r.project_id, secs(r.window_start), secs(r.window_end), r.item_count,
             r.account_count) for r in rows}


def closing(seconds):
    """A row of nobody that moves the clock."""
    return [(None, seconds, None)]


def bursts(stream):
    return stateful.burst_windows(stream, RULE, "30 seconds")


def test_state_gives_the_windows_of_the_batch_job(spark, tmp_path):
    deal = random.Random(5)
    # slots of an hour are crossed, one project is dense, rows repeat and tie
    rows = [("p", s * 9, f"a{s % 4}") for s in range(900)]
    rows += [("q", deal.randrange(8000), f"a{deal.randrange(5)}") for _ in range(400)]
    rows += rows[:50]
    rows.sort(key=lambda r: r[1])
    held = deliver(spark, tmp_path, [rows[:500], rows[500:510], rows[510:], closing(90_000)], bursts)
    full = greedy(rows, 60, 4, 3)
    assert found(held[1]) < found(held[3]) == full
    assert len(held[3]) == len(full)


def test_late_rows_and_rows_of_nobody(spark, tmp_path):
    first = [("p", s, f"a{s}") for s in (0, 10, 20, 30, 20_000)]
    late = [("p", 15, "zz"), (None, 20_010, "x"), ("p", 20_010, None)]
    held = deliver(spark, tmp_path, [first, late, closing(90_000)], bursts)
    assert found(held[2]) == {("p", 0, 30, 4, 4)}


@pytest.mark.parametrize("seed", range(20))
def test_starts_of_a_slot_against_a_loop(seed):
    deal = random.Random(seed)
    rows = {(deal.randrange(400), deal.randrange(4)): deal.randrange(1, 3) for _ in range(60)}
    unit = 1_000_000
    got = stateful.qualifying(
        np.array([t * unit for t, _ in rows]), np.array(list(rows.values())),
        np.array([a for _, a in rows]), 100 * unit, 300 * unit, RULE,
    )
    want = []
    for at in sorted({t for t, _ in rows if 100 <= t < 300}):
        inside = {k: n for k, n in rows.items() if at <= k[0] <= at + 60}
        people = len({a for _, a in inside})
        if sum(inside.values()) >= 4 and people >= 3:
            want.append((at, max(t for t, _ in inside), sum(inside.values()), people))
    assert [tuple(r) for r in (got // [unit, unit, 1, 1]).itertuples(index=False)] == want


def test_panes_count_rows_once_and_accounts_over_two(spark, tmp_path):
    rows = [("p", s, f"a{s % 7}") for s in range(0, 600, 5)]
    rows += [("q", s, "one") for s in range(0, 600, 5)] + [("r", s, "") for s in range(0, 60, 9)]
    rows += [("r", 70, "b"), ("r", 71, "c")]
    rows.sort(key=lambda r: r[1])
    rule = BurstRule(window_seconds=60, minimum_items=4, minimum_accounts=3)
    held = deliver(spark, tmp_path, [rows[:90], rows[90:], closing(90_000)],
                   lambda stream: windows.busy_windows(stream, rule, "30 seconds"))[2]
    got = {(r.project_id, (r.window_start - BASE) // timedelta(seconds=1)): (r.items, r.accounts)
           for r in held}
    want = {}
    for project in "pqr":
        for low in range(-60, 660, 60):
            inside = [a for p, s, a in rows if p == project and low <= s < low + 120]
            if len(inside) >= 4 and len(set(inside)) >= 3:
                want[project, low] = (len(inside), len(set(inside)))
    assert got == want and {p for p, _ in got} == {"p", "r"}


def test_a_slot_holds_one_entry_for_each_arrow_batch():
    import pandas as pd

    class Held(list):
        exists, get, appendList = (lambda self: bool(self)), (lambda self: iter(self)), list.extend

    class Handle:
        def __init__(self):
            self.timers = []
            self.registerTimer = self.timers.append

        def getListState(self, name, schema):
            return Held()

    slots = stateful.SlotStarts(RULE)
    slots.init(Handle())
    times = [s * 1_000_000 for s in range(1000) for _ in "ab"]
    names = ["x", "x"] * 500 + [None, "y"] * 500
    part = pd.DataFrame({"account_id": names, "t": times})
    for rows in (part[:1500], part[1500:]):
        list(slots.handleInputRows(("t", "p", 0), iter([rows]), None))
    assert len(slots.rows) == 2 and len(slots.handle.timers) == 1
    # "x" is one entry a second, no name and "y" are two
    assert sum(len(entry[1]) for entry in slots.rows) == 1500
    [got] = slots.handleExpiredTimer(("t", "p", 0), None, None)
    assert not slots.rows
    assert got["at"].tolist() == [s * 1_000_000 for s in range(440, 500)]
    assert set(got["items"]) == {122} and set(got["accounts"]) == {3}


@pytest.mark.parametrize("name", ["stream_bursts_stateful", "stream_bursts"])
def test_replay_loses_no_row_when_ids_are_not_in_order_of_time(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(
        "CREATE TABLE events AS SELECT event_id + 1000 * k AS event_id, ts, user_id + 40 * k AS user_id, event_type,"
        " value, props FROM (SELECT * FROM '/root/testdata/sf0.001/events.parquet' WHERE event_id < 1000), range(5) r(k)"
    )
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall()) and got
