"""SimHash near-duplicates by covering anchors.

A 64-bit fingerprint is linked to every other one that differs in at most
``DISTANCE`` = 3 bits. Its two halves of 32 bits share the differences, so at
least one half differs in at most one bit (the threshold within a half).

Anchors of a half are a covering code: the perfect [31,26] Hamming code over the
low 31 bits, beside the free top bit. Its covering radius is 1, so every half has
exactly one *home* anchor within 1. A fingerprint is replicated to every anchor
within radius + threshold = 2 of each half: its home, the home with the other top
bit, and the 15 anchors two bits away (or none, if it is itself an anchor). If
two halves differ in at most one bit, the home of one is within 2 of the other,
so the two meet at that anchor. Comparing the homes of each anchor with
everything replicated there finds every link.

Equal fingerprints are merged first, so copies cost one row. Within an anchor a
breadth-first search gives edges that keep what is connected, at most about one
per row, not all pairs. An anchor that is home to more than ``HOMES`` different
fingerprints is split into blocks of homes, each with its own copy of the
anchor's replicas, so no task holds more than that many homes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import batch, components, documents, small_batches
from murmur.session import materialise

SHINGLE = 3
SEED = 42
DISTANCE = 3
HOMES = 4096
#: Replicas compared at a time with a block of homes.
BLOCK = 65_536

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set where over half the hashes of the word shingles have it; 0 without words.

    Words are runs of anything but ASCII white space; A-Z are lower-cased. Fewer
    words than ``width`` make one shingle of them all.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = len(words) - width + 1
    if n < 1:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends, at = [], -1
        for word in words:
            at += len(word) + 1
            ends.append(at)
        digest = xxhash.xxh64_intdigest
        starts = [0] + [e + 1 for e in ends[: n - 1]]
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=True)]
    bits = np.unpackbits(
        np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    )
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the unsigned value's bits as a long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            values = np.array([fingerprint(t) for t in rows.column(1).to_pylist()], dtype=np.uint64)
            yield batch(FINGERPRINTS, {"doc_id": rows.column(0), "fp": values.view(np.int64)})

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


#: For each bit of a syndrome, the positions 1..31 whose number has that bit.
_MASKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def syndrome(half: Column) -> Column:
    bits = [
        F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))).cast("int") % 2, k)
        for k, mask in enumerate(_MASKS)
    ]
    out = bits[0]
    for bit in bits[1:]:
        out = out + bit
    return out


def _flip(value: Column, position: Column) -> Column:
    """``value`` with bit ``position`` (from 1; 0 for none) turned over."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), position - 1)
    return F.when(position == 0, value).otherwise(value.bitwiseXOR(one))


def anchored(prints: DataFrame) -> DataFrame:
    """Rows (half, anchor, home, fp, node) of every anchor near a half of ``fp``."""
    halves = prints.select(
        "fp",
        "node",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("x")),
                F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("x")),
            )
        ).alias("h"),
    ).select("fp", "node", "h.half", "h.x")
    with_home = halves.withColumn("s", syndrome(F.col("x"))).withColumn("home", _flip(F.col("x"), F.col("s")))
    pairs = F.transform(
        F.filter(
            F.sequence(F.lit(1), F.lit(31)),
            lambda j: (F.col("s") != 0) & (j < j.bitwiseXOR(F.col("s"))),
        ),
        lambda j: _flip(_flip(F.col("x"), j), j.bitwiseXOR(F.col("s"))),
    )
    near = F.concat(
        F.array(F.col("home"), F.col("home").bitwiseXOR(F.lit(1 << 31))), pairs
    )
    return with_home.select("half", "fp", "node", "home", F.explode(near).alias("anchor")).select(
        "half", "anchor", (F.col("anchor") == F.col("home")).alias("home"), "fp", "node"
    )


def link_bucket(
    homes: np.ndarray, home_nodes: np.ndarray, fps: np.ndarray, nodes: np.ndarray, distance: int
) -> Iterator[tuple[int, int]]:
    """Edges that connect what links between ``homes`` and ``fps`` connect; no pair twice."""
    root = np.full(len(fps), -1, dtype=np.int64)
    index = {int(f): i for i, f in enumerate(homes)}
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pending = dict.fromkeys(range(len(homes)))
    while pending:
        first = next(iter(pending))
        queue = [first]
        del pending[first]
        label = len(parent)
        parent.append(label)
        while queue:
            at = queue.pop()
            for lo in range(0, len(fps), BLOCK):
                part = fps[lo : lo + BLOCK]
                near = np.flatnonzero(np.bitwise_count(part ^ homes[at]) <= distance) + lo
                seen = root[near]
                fresh = near[seen < 0]
                root[fresh] = label
                for j in fresh.tolist():
                    if nodes[j] != home_nodes[at]:
                        yield int(home_nodes[at]), int(nodes[j])
                    k = index.get(int(fps[j]))
                    if k is not None and k in pending:
                        del pending[k]
                        queue.append(k)
                old, where = np.unique(seen[seen >= 0], return_index=True)
                joined = near[seen >= 0]
                for other, w in zip(old.tolist(), where.tolist(), strict=True):
                    a, b = find(label), find(other)
                    if a != b:
                        parent[a] = b
                        yield int(home_nodes[at]), int(nodes[joined[w]])


def links(prints: DataFrame, distance: int = DISTANCE, homes_limit: int = HOMES) -> DataFrame:
    """Edges (a, b) between nodes. ``prints`` has unsigned bits ``fp``, distinct, and ``node``."""
    small_batches(prints.sparkSession)
    rows = anchored(prints)
    heavy = (
        rows.where("home")
        .groupBy("half", "anchor")
        .count()
        .where(F.col("count") > homes_limit)
        .select("half", "anchor", F.ceil(F.col("count") / homes_limit * 2).cast("int").alias("blocks"))
    )
    block_of = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    # replicas meet every block of homes; a home lies in one block and is a replica as well
    split = rows.join(heavy, ["half", "anchor"], "left").select(
        "half", "anchor", "home", "fp", "node", F.explode(every).alias("block"), block_of.alias("own")
    ).select("half", "anchor", "block", (F.col("home") & (F.col("own") == F.col("block"))).alias("home"), "fp", "node")
    dealt = split.repartition("half", "anchor", "block").sortWithinPartitions(
        "half", "anchor", "block", F.desc("home"), "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _buckets(batches):
            a, b = [], []
            home = group["home"]
            pairs = link_bucket(
                group["fp"][home], group["node"][home], group["fp"], group["node"], distance
            )
            for x, y in pairs:
                a.append(x)
                b.append(y)
                if len(a) >= 10_000:
                    yield batch(EDGES, {"a": a, "b": b})
                    a, b = [], []
            if a:
                yield batch(EDGES, {"a": a, "b": b})

    return dealt.mapInArrow(run, "a long, b long")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Anchors with a home and at least two rows, from rows sorted by anchor."""
    carry: dict[str, np.ndarray] | None = None
    for rows in batches:
        if not rows.num_rows:
            continue
        now = {
            "key": np.stack(
                [
                    np.asarray(rows.column("anchor").to_numpy(zero_copy_only=False), dtype=np.int64),
                    np.asarray(rows.column("half").to_numpy(zero_copy_only=False), dtype=np.int64) << 32
                    | np.asarray(rows.column("block").to_numpy(zero_copy_only=False), dtype=np.int64),
                ],
                axis=1,
            ),
            "home": np.asarray(rows.column("home").to_numpy(zero_copy_only=False), dtype=bool),
            "fp": np.asarray(rows.column("fp").to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64),
            "node": np.asarray(rows.column("node").to_numpy(zero_copy_only=False), dtype=np.int64),
        }
        if carry is not None:
            now = {k: np.concatenate([carry[k], now[k]]) for k in now}
        key = now["key"]
        ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], ends])
        stops = np.concatenate([ends, [len(key)]])
        whole = starts[:-1][(stops[:-1] - starts[:-1] > 1) & now["home"][starts[:-1]]]
        size = dict(zip(starts.tolist(), stops.tolist(), strict=True))
        for lo in whole.tolist():
            yield {k: v[lo : size[lo]] for k, v in now.items()}
        carry = {k: v[starts[-1] :] for k, v in now.items()}
    if carry is not None and len(carry["fp"]) > 1 and carry["home"][0]:
        yield carry


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    The component is the smallest doc_id that links reach. Null and empty texts
    have fingerprint zero and are linked like any other. A null doc_id keeps its
    row and takes part in no choice of the smallest: its component is that of its
    fingerprint, or null if no row that it reaches has an id. Repeated rows stay.
    """
    prints = materialise(fingerprints(docs), "simhash-prints")
    # the node of a fingerprint is its smallest id; one without any id takes a negative number
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = materialise(
        nodes.select("fp", "low", F.xxhash64("fp", F.lit("node")).alias("node")), "simhash-nodes"
    )
    found = components(links(nodes.select("fp", "node"), distance), "simhash")
    classes = (
        nodes.join(found, "node", "left")
        .select("fp", "low", F.coalesce("component", "node").alias("class"))
    )
    lowest = classes.groupBy("class").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "class").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
