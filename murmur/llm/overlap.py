"""Near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sketches of a text's shingles, made in one pass:

* its SimHash fingerprint, linked within three bits by covering anchors
  (:mod:`murmur.llm.simhash`), which finds most of the closest copies at one row each;
* ``BANDS`` bands of ``ROWS`` minimum hashes, as at a similarity of 0.8 fingerprints
  differ in some ten bits, beyond what anchors can cover. A pair at 0.8 shares no band
  with probability (1 - 0.8^4)^24 = 3.2e-6, a closer one with less.

Every candidate is then compared by its whole sets of shingles, so nothing below 0.8 is
linked. Shared passages and common lines do not list texts together unless most of the
shingles agree.

Equal word sequences are merged first. Lists with the same members count once. Each
member is compared with the smallest of its list; only lists whose members are then
still in different components are compared throughout, and there each text meets an
inverted index of the others. A list of more than ``HOMES`` members is split into
blocks, each with its own index, that all members pass by. Edges are written where
they connect something, not for all pairs.

Words are runs of anything but ASCII white space; A-Z are lower-cased. Fewer words
than ``WIDTH`` make one shingle of them all. Texts without words equal each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm import simhash
from murmur.llm.common import batch, components, documents, small_batches
from murmur.session import materialise

WIDTH = 5
SEED = 42
HOMES = 4096
BANDS, ROWS = 24, 4
#: Shingles that are hashed at a time.
PIECE = 8192
#: Texts to compare that are named to tasks, as a sorted array of longs; more are found by a shuffle join.
NAMED = 1_000_000

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def node_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63)


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the shingles, in order."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    n = len(words) - WIDTH + 1
    if n < 2:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        digest = xxhash.xxh64_intdigest
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[WIDTH - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, dtype=np.uint64).view(np.int64))


def alike(shared, n, m):
    """Jaccard similarity of at least 0.8, in whole numbers."""
    return 9 * shared >= 4 * (n + m)


_RANDOM = np.random.default_rng(SEED)
#: Odd factors and summands of the hash functions.
FACTORS, SUMMANDS = (_RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)


def bands_of(found: np.ndarray) -> list[int]:
    """Hash of each band of minimum hashes of a set of shingles."""
    values = found.view(np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(values), PIECE):
        mixed = values[i : i + PIECE, None] * FACTORS
        mixed += SUMMANDS
        np.minimum(least, mixed.min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles, the bits of an unsigned value as a long."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), PIECE):
        ones += np.unpackbits(found[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


SKETCHES = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sketches(docs: DataFrame) -> DataFrame:
    """Distinct (node, size, fp, bands): the number of shingles and both sketches of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {f.name: [] for f in SKETCHES}
            seen = set()
            for text in rows.column(1):
                words = words_of(text.as_py())
                node = node_of(words)
                if words and node not in seen:
                    seen.add(node)
                    found = shingles(words)
                    for name, value in zip(out, (node, len(found), fingerprint(found), bands_of(found)), strict=True):
                        out[name].append(value)
            yield batch(SKETCHES, out)

    found = documents(docs).mapInArrow(run, "node long, size long, fp long, bands array<long>")
    return materialise(found.dropDuplicates(["node"]), "overlap-sketches")


def anchored_pairs(drawn: DataFrame) -> DataFrame:
    """(a, b) that covering anchors connect: fingerprints within three bits, and texts with the same one."""
    heads = materialise(drawn.groupBy("fp").agg(F.min("node").alias("head")), "overlap-prints")
    same = drawn.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return simhash.links(heads.select("fp", F.col("head").alias("node"))).where("a <> b").union(same)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in the column ``node`` of ``wanted``."""
    spark = docs.sparkSession
    named = None
    if wanted.limit(NAMED + 1).count() <= NAMED:
        named = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column("node").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = {}
            for text in rows.column(1).to_pylist():
                words = words_of(text)
                node = node_of(words)
                if node in out:
                    continue
                if named is not None:
                    at = np.searchsorted(named.value, node)
                    if at == len(named.value) or named.value[at] != node:
                        continue
                out[node] = shingles(words)
            yield batch(SETS, {"node": list(out), "shingles": list(out.values())})

    found = documents(docs).mapInArrow(run, "node long, shingles array<long>")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


class Block:
    """An inverted index of some members of a list."""

    def __init__(self, homes: list[tuple[int, int, np.ndarray]]):
        self.nodes = [n for n, _, _ in homes]
        self.groups = [c for _, c, _ in homes]
        self.sizes = np.array([len(s) for _, _, s in homes])
        every = np.concatenate([s for _, _, s in homes])
        order = np.argsort(every, kind="stable")
        self.values, self.owners = every[order], np.repeat(np.arange(len(homes)), self.sizes)[order]
        self.parent: dict[int, int] = {}

    def root(self, group: int) -> int:
        while (above := self.parent.get(group, group)) != group:
            self.parent[group] = group = self.parent.get(above, above)
        return group

    def meet(self, node: int, group: int, found: np.ndarray) -> Iterator[tuple[int, int]]:
        """Edges to members of other components, one for each."""
        lo = np.searchsorted(self.values, found)
        n = np.searchsorted(self.values, found, "right") - lo
        lo, n = lo[n > 0], n[n > 0]
        if not len(n):
            return
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owners[at], minlength=len(self.nodes))
        for i in np.flatnonzero(alike(shared, self.sizes, len(found))).tolist():
            a, b = self.root(group), self.root(self.groups[i])
            if a != b:
                self.parent[a] = b
                yield node, self.nodes[i]


def throughout(members: DataFrame) -> DataFrame:
    """Edges between members (bucket, block, home, node, component, shingles) of each block."""
    dealt = members.repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.desc("home"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, block = None, [], None
        edges: list[tuple[int, int]] = []

        def index() -> None:
            nonlocal block
            block = Block(homes)
            for home in homes:
                edges.extend(block.meet(*home))

        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in ("bucket", "block", "home", "node", "component")]
            lists = rows.column("shingles")
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, (bucket, part, home, node, group) in enumerate(zip(*columns, strict=True)):
                if (bucket, part) != key:
                    if homes and block is None:
                        index()
                    key, homes, block = (bucket, part), [], None
                member = (node, group, values[offsets[k] : offsets[k + 1]].copy())
                if home:
                    homes.append(member)
                elif homes:
                    if block is None:
                        index()
                    edges.extend(block.meet(*member))
            yield batch(EDGES, {"a": [a for a, _ in edges], "b": [b for _, b in edges]})
            edges.clear()
        if homes and block is None:
            index()
        yield batch(EDGES, {"a": [a for a, _ in edges], "b": [b for _, b in edges]})

    return dealt.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, homes: int = HOMES) -> DataFrame:
    """Edges (a, b) that connect the nodes which pairs of similar texts connect."""
    small_batches(docs.sparkSession)
    drawn = sketches(docs)
    near = 5 * F.least("size", "other.size") >= 4 * F.greatest("size", "other.size")
    lists = drawn.select(F.explode("bands").alias("h"), "node", "size")
    # same members, same marks: of such lists one is enough
    marks = lists.groupBy("h").agg(
        F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("leader"),
        F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"),
    ).where("n > 1")
    buckets = materialise(marks.groupBy("n", "leader", "x", "y").agg(F.min("h").alias("h")).select("h", "n", "leader"), "overlap-buckets")
    members = materialise(lists.join(buckets, "h").select(F.col("h").alias("bucket"), "n", "leader", "node", "size"), "overlap-members")
    led = members.withColumnRenamed("leader", "other").where((F.col("node") != F.col("other.node")) & near)
    sizes = drawn.select("node", "size")
    anchored = (
        anchored_pairs(drawn)
        .join(sizes.withColumnRenamed("node", "b"), "b")
        .join(sizes.select(F.col("node").alias("a"), F.struct("node", "size").alias("other")), "a")
        .where(near)
    )
    pairs = materialise(
        led.select(F.col("other.node").alias("leader"), "node")
        .union(anchored.select(F.col("a").alias("leader"), F.col("b").alias("node")))
        .distinct(),
        "overlap-pairs",
    )
    wanted = members.select("node").union(pairs.select("node")).union(pairs.select("leader")).distinct()
    sets = materialise(sets_of(docs, wanted), "overlap-sets")
    shared = F.size(F.array_intersect("shingles", "others"))
    first = materialise(
        pairs.join(sets, "node")
        .join(sets.select(F.col("node").alias("leader"), F.col("shingles").alias("others")), "leader")
        .where(alike(shared, F.size("shingles"), F.size("others")))
        .select(F.col("leader").alias("a"), F.col("node").alias("b")),
        "overlap-first",
    )
    groups = materialise(components(first, "overlap-first"), "overlap-groups")
    placed = members.join(groups, "node", "left").select(
        "bucket", "n", "node", F.coalesce("component", "node").alias("component")
    )
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    blocks = F.when(F.col("n") > homes, F.ceil(F.col("n") / homes * 2)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    open_ = (
        placed.join(mixed, "bucket")
        .select("bucket", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        .select("bucket", "block", (F.col("own") == F.col("block")).alias("home"), "node", "component")
        .join(sets, "node")
        .select("bucket", "block", "home", "node", "component", "shingles")
    )
    return first.union(throughout(open_))


def near_copies(docs: DataFrame, homes: int = HOMES) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest id that similar texts reach, of every row.

    A null doc_id keeps its row and takes part in no choice of the smallest.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            nodes = [node_of(words_of(t)) for t in rows.column(1).to_pylist()]
            yield batch(schema, {"doc_id": rows.column(0), "node": nodes})

    ids = materialise(documents(docs).mapInArrow(run, "doc_id long, node long"), "overlap-ids")
    lows = ids.groupBy("node").agg(F.min("doc_id").alias("low"))
    found = components(links(docs, homes), "overlap")
    classes = lows.join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("class"))
    lowest = classes.groupBy("class").agg(F.min("low").alias("component_id"))
    return ids.join(classes.join(lowest, "class").select("node", "component_id"), "node").select("doc_id", "component_id")
