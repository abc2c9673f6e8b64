"""Burst windows kept in the state store: event-time timers, one key per slot of a project.

Two stateful steps in one streaming query:

1. per (tenant, project, slot) the rows of a slot and of one window behind it wait until the
   watermark has passed them. A timer then works out every start of the slot that qualifies
   and clears the state. Slots are those of :mod:`murmur.operators.burst`, about an hour, so
   a busy project is as many keys as it has slots, and what is held is bounded by slot, rule
   width and delay;
2. per (tenant, project) the starts that qualify arrive in order, as timers of earlier slots
   fire in the same or an earlier batch. The state is one number, the moment covered so far.

Results are those of the batch job for all rows in front of the watermark, with no version
folders: the checkpoint holds the state, and the file sink writes a replayed batch once.

Rows without tenant or project belong to nobody but move the clock, so a source that fell
silent is closed by sending such a row. Rows without a time are left out. What a batch adds to
a slot is one entry of the state for each Arrow batch it comes in, as arrays in which rows of
equal account and moment are one. Late rows are dropped by the engine and are
counted in the progress of the query (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from murmur.functions.moments import MICROS, from_micros, micros
from murmur.operators.burst import SCOPE, BurstRule, cell_of

MILLIS = 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STARTS = (
    "tenant_id string, project_id string, at long, last long, items long, accounts long"
)


def _known(key: tuple) -> bool:
    return all(k is not None and k == k for k in key)


def qualifying(
    times: np.ndarray, counts: np.ndarray, accounts: np.ndarray, low: int, high: int,
    rule: BurstRule,
) -> pd.DataFrame:
    """Moments in [low, high) at which the rule fires, from rows that are one per account and moment.

    An item counts for every start in the window before it, and as an account only for starts
    behind that account's previous item.
    """
    gap = rule.window_seconds * MICROS
    order = np.lexsort((times, accounts))
    opens = times[order] - gap
    again = np.zeros(len(order), dtype=bool)
    again[1:] = accounts[order][1:] == accounts[order][:-1]
    previous = np.roll(times[order], 1)
    opens = np.sort(np.where(again, np.maximum(opens, previous + 1), opens))
    order = np.argsort(times, kind="stable")
    times, total = times[order], np.concatenate([[0], np.cumsum(counts[order])])
    at = np.unique(times[(times >= low) & (times < high)])
    first = np.searchsorted(times, at, side="left")
    behind = np.searchsorted(times, at + gap, side="right")
    found = pd.DataFrame(
        {
            "at": at,
            "last": times[behind - 1],
            "items": total[behind] - total[first],
            "accounts": np.searchsorted(opens, at, side="right") - first,
        }
    )
    return found[
        (found["items"] >= rule.minimum_items) & (found["accounts"] >= rule.minimum_accounts)
    ]


def merged(accounts: pa.Array, times: pa.Array, counts: pa.Array) -> tuple[pa.Array, ...]:
    """One row per account and moment. No name is an account too."""
    rows = pa.table({"account": accounts, "t": times, "n": counts})
    found = rows.group_by(["account", "t"], use_threads=False).aggregate([("n", "sum")])
    return tuple(found[c].combine_chunks() for c in ("account", "t", "n_sum"))


class SlotStarts(StatefulProcessor):
    """Holds the rows of a slot until none can come any more."""

    def __init__(self, rule: BurstRule):
        self.rule = rule
        self.length = rule.slot_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "account_id array<string>, t array<long>, n array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not _known(key):
            return
        if not self.rows.exists():
            end = (int(key[2]) + 1) * self.length + self.rule.window_seconds * MICROS
            self.handle.registerTimer(end // MILLIS)
        self.rows.appendList(
            [
                tuple(
                    column.to_pylist()
                    for column in merged(
                        pa.array(part["account_id"], pa.string(), from_pandas=True),
                        pa.array(part["t"].to_numpy("int64")),
                        pa.array(np.ones(len(part), dtype="int64")),
                    )
                )
                for part in rows
            ]
        )
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.rows.get())
        self.rows.clear()
        kinds = pa.string(), pa.int64(), pa.int64()
        accounts, times, counts = merged(
            *[
                pa.concat_arrays([pa.array(entry[i], kind, from_pandas=True) for entry in held])
                for i, kind in enumerate(kinds)
            ]
        )
        low = int(key[2]) * self.length
        found = qualifying(
            times.to_numpy(), counts.to_numpy(),
            accounts.dictionary_encode(null_encoding="encode").indices.to_numpy(),
            low, low + self.length, self.rule,
        )
        if len(found):
            found.insert(0, "tenant_id", key[0])
            found.insert(1, "project_id", key[1])
            yield found

    def close(self) -> None:
        pass


class Spaced(StatefulProcessor):
    """Takes a start, passes over all within the window, takes the next."""

    def __init__(self, rule: BurstRule):
        self.gap = rule.window_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.covered = handle.getValueState("covered", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        starts = pd.concat(list(rows)).sort_values("at", ignore_index=True)
        at = starts["at"].to_numpy("int64")
        until = self.covered.get()[0] if self.covered.exists() else None
        place = 0 if until is None else int(np.searchsorted(at, until, side="right"))
        taken = []
        while place < len(at):
            taken.append(place)
            until = int(at[place]) + self.gap
            place = int(np.searchsorted(at, until, side="right"))
        if taken:
            self.covered.update((until,))
            yield starts.iloc[taken]

    def close(self) -> None:
        pass


def burst_windows(stream: DataFrame, rule: BurstRule, delay: str) -> DataFrame:
    """Windows that fire: scope, window_start, window_end, item_count, account_count."""
    length, gap = F.lit(rule.slot_seconds * MICROS), rule.window_seconds * MICROS
    own = cell_of(F.col("t"), length)
    # the rows in the first W of a slot also belong to windows that start in the slot before
    shown = F.when(F.col("t") < own * length + gap, F.array(own, own - 1)).otherwise(F.array(own))
    timed = (
        stream.withWatermark("posted_at", delay)
        .select(*SCOPE, "account_id", "posted_at", micros(F.col("posted_at")).alias("t"))
        .where(F.col("t").isNotNull())
        .select("*", F.explode(shown).alias("slot"))
    )
    starts = timed.groupBy(*SCOPE, "slot").transformWithStateInPandas(
        SlotStarts(rule), STARTS, outputMode="append", timeMode="EventTime"
    )
    chosen = starts.groupBy(*SCOPE).transformWithStateInPandas(
        Spaced(rule), STARTS, outputMode="append", timeMode="None"
    )
    return chosen.select(
        *SCOPE,
        from_micros(F.col("at")).alias("window_start"),
        from_micros(F.col("last")).alias("window_end"),
        F.col("items").alias("item_count"),
        F.col("accounts").alias("account_count"),
    )


def with_state_store(spark: SparkSession, drive) -> None:
    """Run ``drive`` with the state store that timers and list state need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        drive()
    finally:
        spark.conf.set(PROVIDER, before)
