"""Greedy choice of points that lie more than a gap apart, without one task per key.

The rule is sequential: take the first point, skip everything within ``gap`` of it,
take the next, and so on. A key may hold a third of the data, so its time line is cut
into slots and the rule is split into three steps:

1. per slot, what the rule does for *every* possible state on entry. The state is one
   number, the last moment already covered, and the outcome is a step function of it
   with few steps, because different starts soon choose the same point;
2. per key, run through those step functions in slot order to learn the state on entry
   to each slot. This reads a few rows per slot, not the points;
3. per slot, choose the points given that state.

Steps 1 and 3 run in parallel over slots. The largest group is one slot of distinct
moments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators.neighbours import in_sequence

#: Smaller than any moment in microseconds.
NEVER = -(2**62)


def _steps(points: np.ndarray, gap: int, slot_start: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and exits: a state below ``bounds[i]`` leaves the slot as ``exits[i]``."""
    following = np.searchsorted(points, points + gap, side="right")
    size = len(points)
    last = np.where(following < size, following, np.arange(size))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    exits = points[last] + gap
    # A point can be the first choice only when the one before it may already be covered.
    reachable = np.ones(size, dtype=bool)
    reachable[1:] = points[:-1] < slot_start + gap
    bounds, exits = points[reachable], exits[reachable]
    keep = np.ones(len(exits), dtype=bool)
    keep[:-1] = exits[1:] != exits[:-1]
    return bounds[keep], exits[keep]


def _groups(columns: list[np.ndarray]) -> list[tuple[int, int]]:
    """Bounds of the runs of equal key values in a sorted batch."""
    size = len(columns[0])
    if size == 0:
        return []
    change = np.zeros(size, dtype=bool)
    change[0] = True
    for values in columns:
        change[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(change)
    return list(zip(starts, np.append(starts[1:], size), strict=True))


def choose_spaced(
    points: DataFrame,
    keys: list[str],
    keep: list[str] | None = None,
    at: str = "at",
    slot: str = "slot",
    gap: str = "gap",
    slot_length: str = "slot_length",
    covered: DataFrame | None = None,
) -> DataFrame:
    """Rows of ``points`` the greedy rule takes, per ``keys``, with the columns ``keep``.

    ``points`` has one row per moment, with ``slot`` = floor(at / slot_length) and
    ``slot_length`` >= ``gap``, all longs; ``gap`` and ``slot_length`` are constant per
    key. ``covered`` (keys, covered_until) carries the state on from an earlier run.

    The points of a slot are read in order and streamed: step 1 holds one slot's moments,
    step 3 one number. Step 2 streams as well, with one slot's few steps at a time.
    """
    group = [*keys, slot]
    fields = {f.name: f for f in points.schema.fields}
    key_fields = [T.StructField(k, fields[k].dataType) for k in keys]
    slot_field = T.StructField(slot, T.LongType())
    payload = [at, *(keep or []), gap]
    lean = points.select(*group, *payload, slot_length)
    if covered is not None:
        # What an earlier run covered cannot be taken; after that the rule starts afresh.
        lean = (
            lean.join(covered.select(*keys, "covered_until"), keys, "left")
            .where(F.col(at) > F.coalesce("covered_until", F.lit(NEVER)))
            .drop("covered_until")
        )

    step_schema = T.StructType(
        [*key_fields, slot_field, T.StructField("below", T.LongType()),
         T.StructField("leaves", T.LongType())]
    )

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, parts, width, start = None, [], 0, 0

        def close() -> list[tuple]:
            below, leaves = _steps(np.concatenate(parts), width, start)
            return [(*current, b, x) for b, x in zip(below.tolist(), leaves.tolist(), strict=True)]

        for batch in batches:
            rows: list[tuple] = []
            columns = [batch[c].to_numpy() for c in group]
            moments = batch[at].to_numpy()
            for lo, hi in _groups(columns):
                name = tuple(c[lo] for c in columns)
                if name != current:
                    if current is not None:
                        rows += close()
                    current, parts = name, []
                    width = int(batch[gap].iat[lo])
                    start = int(name[-1]) * int(batch[slot_length].iat[lo])
                parts.append(moments[lo:hi])
            yield pd.DataFrame(rows, columns=step_schema.names)
        if current is not None:
            yield pd.DataFrame(close(), columns=step_schema.names)

    ordered = in_sequence(lean, group, [at])
    functions = ordered.select(*group, at, gap, slot_length).mapInPandas(steps, step_schema)
    entry_schema = T.StructType([*key_fields, slot_field, T.StructField("state", T.LongType())])

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Run through the step functions of a key's slots, in order, with one state."""
        current, state = None, NEVER
        slot_now, entered, bounds, exits = None, NEVER, [], []

        def leave() -> int:
            pick = int(np.searchsorted(np.concatenate(bounds), entered, side="right"))
            leaving = np.concatenate(exits)
            return int(leaving[pick]) if pick < len(leaving) else entered

        for batch in batches:
            rows: list[tuple] = []
            columns = [batch[c].to_numpy() for c in group]
            below, leaves = batch["below"].to_numpy(), batch["leaves"].to_numpy()
            for lo, hi in _groups(columns):
                name = tuple(c[lo] for c in columns)
                if name != slot_now:
                    if slot_now is not None:
                        state = leave()
                    if name[:-1] != current:
                        current, state = name[:-1], NEVER
                    slot_now, entered, bounds, exits = name, state, [], []
                    rows.append((*name, state))
                bounds.append(below[lo:hi])
                exits.append(leaves[lo:hi])
            yield pd.DataFrame(rows, columns=entry_schema.names)

    on_entry = in_sequence(functions, keys, [slot, "below"]).mapInPandas(entries, entry_schema)

    chosen_schema = T.StructType(
        [*key_fields, slot_field, *[T.StructField(n, fields[n].dataType) for n in payload]]
    )

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, NEVER
        for batch in batches:
            taken: list[int] = []
            columns = [batch[c].to_numpy() for c in group]
            moments, gaps = batch[at].to_numpy(), batch[gap].to_numpy()
            marks = batch["state"].to_numpy()
            for lo, hi in _groups(columns):
                name = tuple(c[lo] for c in columns)
                if name != current:
                    # The state on entry sorts before the slot's points.
                    current, state = name, int(marks[lo])
                    lo += 1
                index = lo + int(np.searchsorted(moments[lo:hi], state, side="right"))
                while index < hi:
                    taken.append(index)
                    state = int(moments[index] + gaps[index])
                    index += int(np.searchsorted(moments[index:hi], state, side="right"))
            yield batch.iloc[taken][chosen_schema.names]

    zero = {n: F.lit(0).cast(fields[n].dataType) for n in [*(keep or []), gap]}
    markers = on_entry.select(
        *group, F.lit(NEVER).alias(at), *[v.alias(n) for n, v in zero.items()], "state"
    )
    marked = lean.select(*group, *payload, F.lit(0).cast("long").alias("state")).unionByName(markers)
    return in_sequence(marked, group, [at]).mapInPandas(choose, chosen_schema)
