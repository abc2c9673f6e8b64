"""Near-duplicate vectors by product quantisation.

Vectors are merged where equal, then compared on the unit sphere, where a cosine of t
is a distance of r = sqrt(2 - 2t).

*Index.* Every vector lies in the inverted list of its nearest coarse centroid; its
residual is coded by the nearest of 256 centroids in each of ``SUBSPACES`` subspaces,
and its coding error e is kept. There are about sqrt(n) lists.
*Probes.* A vector x in list h meets list c where it lies near enough to the plane
between both centroids: (d(x,c)^2 - d(x,h)^2) / 2d(c,h) <= ``reach`` * r. Nothing in c
is within r of x otherwise if reach is 1. The reach is 5 / sqrt(D) and at most 1, D
being the number of directions in which the sample spreads: of a difference that favours
no direction, the part along one given direction exceeds that five standard deviations
in less than a millionth of the cases. Of two lists one probes the other.
*Distances.* One table of x by subspace and code gives the distance to every coded
vector by look-ups. Whatever is beyond r + e is farther than r by the triangle
inequality; the rest is ranked again by exact cosine in double precision.

Lists that lie together are dealt to shards of about 8 sqrt(n) vectors, a list larger
than that to several. A vector is sent once to a shard, not once to a list. A task holds
the vectors of one shard and streams what probes it. It counts links and writes edges
where they connect something, not all pairs; equal vectors count without being compared.

Centroids are learned from about ``TRAIN`` distinct vectors chosen by hash; every vector
is indexed, and no list, probe or candidate is capped. Null or empty vectors, those with
null or non-finite components and zero vectors link with nothing. Vectors of different
length never link. A null vec_id keeps its row, counts as a link of others and takes
part in no choice of the smallest. Repeated rows are separate vectors. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import batch, components, small_batches
from murmur.session import materialise

COSINE = 0.95
SUBSPACES, CODES = 8, 256
#: Distinct vectors that centroids are learned from, and lists at most.
TRAIN, LISTS = 16_384, 4096
#: Vectors of a shard in roots of n, and at most (they are held by one task).
SHARD, HELD = 8, 65_536
ROUNDS = 8
#: Pairs that are ranked again at a time.
PAIRS = 50_000
SLACK = 1e-4

INDEX = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("vector", pa.binary()), ("list", pa.int32()), ("codes", pa.binary()), ("err", pa.float64())])
DEALT = pa.schema([("shard", pa.int32()), ("home", pa.bool_()), ("part", pa.int32()), *INDEX])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of every row."""
    half = 0.5 * (centres**2).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)])


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def unit(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of length one, padded with zeros; scaling by powers of two first loses nothing."""
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    out = np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0.0))[1][:, None])
    return out / np.sqrt((out**2).sum(axis=1))[:, None]


class Quantiser:
    """Coarse centroids, residual codebooks and the probing rule."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float):
        self.radius = math.sqrt(2 - 2 * cosine)
        self.width = sample.shape[1]
        self.coarse = kmeans(sample, min(lists, len(sample)), 1)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = [c for c in np.array_split(np.arange(self.width), min(SUBSPACES, self.width))]
        self.books = [kmeans(rest[:, c], min(CODES, len(sample)), 2 + i) for i, c in enumerate(self.cuts)]
        spread = np.linalg.eigvalsh(np.cov(sample, rowvar=False, bias=True).reshape(self.width, self.width))
        directions = spread.sum() ** 2 / max((spread**2).sum(), 1e-300)
        self.reach = min(1.0, 5 / math.sqrt(max(directions, 1.0)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of every row."""
        own = nearest(x, self.coarse)
        rest = x - self.coarse[own]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        return own, codes.astype(np.uint8), np.sqrt(((rest - self.decoded(codes)) ** 2).sum(axis=1))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Products of every row with every code: (subspace, code, row)."""
        out = np.zeros((len(self.books), CODES, len(x)), dtype=np.float32)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[i, : len(b)] = b @ x[:, c].T
        return out

    def probed(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray, slack: float = 1e-9) -> np.ndarray:
        """Which rows of ``x``, in lists ``own``, have to meet which of ``lists``."""
        c, h = self.coarse[lists], self.coarse[own]
        to_c = (c**2).sum(axis=1) - 2 * x @ c.T
        to_h = (h**2).sum(axis=1) - 2 * (x * h).sum(axis=1)
        between = np.sqrt(np.maximum((c**2).sum(axis=1) + (h**2).sum(axis=1)[:, None] - 2 * h @ c.T, 1e-300))
        near = (to_c - to_h[:, None]) / (2 * between) <= self.reach * self.radius + slack
        return turn(own[:, None], lists[None, :]) & near | (own[:, None] == lists[None, :])


def turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two different numbers exactly one has its turn to go to the other; each number goes to half."""
    return (a < b) == ((a + b) % 2 == 0)


class Shards:
    """Where the vectors of every list lie: list -> first shard and number of parts."""

    def __init__(self, coarse: np.ndarray, counts: np.ndarray, homes: int):
        groups = max(1, math.ceil(counts.sum() / homes))
        together = nearest(coarse, kmeans(coarse, min(groups, len(coarse)), 99))
        self.first, self.parts = np.zeros(len(counts), dtype=np.int64), np.maximum(1, -(-counts // homes))
        at, held, last = 0, 0, -1
        for i in np.lexsort((np.arange(len(counts)), together)).tolist():
            if held and (held + counts[i] > homes or self.parts[i] > 1 or (together[i] != last and 2 * held >= homes)):
                at, held = at + 1, 0
            self.first[i], last = at, together[i]
            held += int(counts[i])
            if self.parts[i] > 1:
                at, held = at + int(self.parts[i]), 0
        self.number = at + 1

    def part(self, lists: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        mixed = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return (mixed % self.parts[lists].astype(np.uint64)).astype(np.int64)


class Held:
    """The vectors of one shard, and what is linked so far."""

    def __init__(self, model: Quantiser, x: np.ndarray, dims: np.ndarray, rows: dict[str, np.ndarray], cosine: float):
        order = np.lexsort((rows["part"], rows["list"]))
        self.model, self.cosine, self.x, self.dims = model, cosine, x[order], dims[order]
        self.node, self.n, self.list, self.part, self.err = (rows[c][order] for c in ("node", "n", "list", "part", "err"))
        self.codes = rows["codes"][order]
        edges = np.flatnonzero((np.diff(self.list) != 0) | (np.diff(self.part) != 0)) + 1
        starts = np.concatenate([[0], edges])
        self.blocks = list(zip(starts.tolist(), np.concatenate([edges, [len(order)]]).tolist(), strict=True))
        self.lists, self.parts = self.list[starts], self.part[starts]
        q, c = model.decoded(self.codes), model.coarse[self.list]
        #: the part of the distance to a coded vector that no probe changes
        self.fixed = ((q**2).sum(axis=1) + 2 * (q * c).sum(axis=1)).astype(np.float32)
        self.limit = (model.radius + self.err) ** 2 + SLACK
        self.count = np.zeros(len(order), dtype=np.int64)
        self.place = {int(v): i for i, v in enumerate(self.node)}
        self.parent = np.arange(len(order))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def probe(self, x: np.ndarray, dims: np.ndarray, node: np.ndarray, n: np.ndarray, own: np.ndarray, part: np.ndarray) -> dict[str, list]:
        """Links of the rows ``x`` with vectors held here: edges, and what is added to each row's count."""
        meets = self.model.probed(x, own, self.lists, 2e-9)
        same = own[:, None] == self.lists
        meets &= ~same | (part[:, None] == self.parts) | turn(part[:, None], self.parts)
        here = np.array([self.place.get(int(v), -1) for v in node])
        table = self.model.tables(x)
        gained = np.zeros(len(x), dtype=np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for b, (lo, hi) in enumerate(self.blocks):
            who = np.flatnonzero(meets[:, b])
            if not len(who):
                continue
            whole = ((x[who] - self.model.coarse[self.lists[b]]) ** 2).sum(axis=1).astype(np.float32)
            sums = np.zeros((hi - lo, len(who)), dtype=np.float32)
            for m in range(table.shape[0]):
                sums += table[m][:, who][self.codes[lo:hi, m]]
            # |x - c|^2 + fixed - 2 x.q is the squared distance to the coded vector
            near = whole + (self.fixed[lo:hi, None] - 2 * sums) <= self.limit[lo:hi, None]
            y, i = np.nonzero(near)
            y, i = y + lo, who[i]
            # pairs of one block are met from both sides: keep one
            keep = (dims[i] == self.dims[y]) & ((here[i] < lo) | (here[i] >= hi) | (here[i] < y))
            pairs.append((i[keep], y[keep]))
        out: dict[str, list] = {"a": [], "b": [], "n": []}
        linked: dict[int, list[np.ndarray]] = {}
        for i, y in pairs:
            for k in range(0, len(i), PAIRS):
                p, q = i[k : k + PAIRS], y[k : k + PAIRS]
                found = np.einsum("ij,ij->i", x[p], self.x[q]) >= self.cosine
                if not found.any():
                    continue
                p, q = p[found], q[found]
                np.add.at(gained, p, self.n[q])
                np.add.at(self.count, q, n[p])
                order = np.argsort(p, kind="stable")
                p, q = p[order], q[order]
                at = np.flatnonzero(np.diff(p)) + 1
                for one, those in zip(p[np.concatenate([[0], at])].tolist(), np.split(q, at), strict=True):
                    linked.setdefault(one, []).append(those)
        for one, those in linked.items():
            roots: dict[int, int] = {}
            for y in np.concatenate(those).tolist():
                roots.setdefault(self.root(y), y)
            if here[one] >= 0:
                roots.pop(self.root(int(here[one])), None)
                roots_all = [self.root(int(here[one])), *roots]
            else:
                roots_all = list(roots)
            out["a"] += [int(node[one])] * len(roots)
            out["b"] += [int(self.node[y]) for y in roots.values()]
            out["n"] += [None] * len(roots)
            for r in roots_all[1:]:
                self.parent[r] = roots_all[0]
        some = np.flatnonzero(gained)
        out["a"] += node[some].tolist()
        out["b"] += [None] * len(some)
        out["n"] += gained[some].tolist()
        return out


def _matrix(column: pa.Array, kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [np.frombuffer(v, dtype=kind) for v in column.to_pylist()]
    return unit(rows, width), np.array([len(v) for v in rows])


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, k1, k2), keys null for what links with nothing, and the distinct vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    fit = F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.select(
        "vec_id", "vector",
        F.when(fit, F.xxhash64("vector")).alias("k1"),
        F.when(fit, F.xxhash64(F.lit("second"), "vector")).alias("k2"),
    )
    distinct = rows.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("vector").alias("vector")
    )
    return rows.drop("vector"), materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "pq-classes")


def train(classes: DataFrame, n: int, width: int, cosine: float) -> Quantiser:
    """Centroids from about ``TRAIN`` distinct vectors; which ones depends on their hash alone."""
    share = 1 << 20
    chosen = classes.where(F.pmod("k1", F.lit(share)) < math.ceil(min(1.0, TRAIN / n) * share))
    sample = sorted(tuple(r) for r in chosen.select("k1", "k2", "vector").collect())
    lists = min(LISTS, math.ceil(math.sqrt(n)))
    return Quantiser(unit([np.array(v, dtype=np.float64) for _, _, v in sample], width), lists, cosine)


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame | None:
    """Rows (a, b) for edges and (a, null, n) for counts of links; None without vectors."""
    spark = classes.sparkSession
    small_batches(spark)
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not size.n:
        return None
    width = size.width
    kind = "<f4" if "array<float>" in dict(classes.dtypes)["vector"] else "<f8"
    model = spark.sparkContext.broadcast(train(classes, size.n, width, cosine))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            vectors = [np.array(v, dtype=np.float64) for v in rows.column("vector").to_pylist()]
            own, codes, err = model.value.encode(unit(vectors, width)) if vectors else ([], [], [])
            yield batch(INDEX, {
                "node": rows.column("node"), "n": rows.column("n"),
                "vector": [v.astype(kind).tobytes() for v in vectors],
                "list": own, "codes": [c.tobytes() for c in codes], "err": err,
            })

    ddl = "node long, n long, vector binary, list int, codes binary, err double"
    indexed = materialise(classes.select("node", "n", "vector").mapInArrow(index, ddl), "pq-index")
    counts = np.zeros(len(model.value.coarse), dtype=np.int64)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect():
        counts[r.list] = r.n
    shards = Shards(model.value.coarse, counts, min(HELD, math.ceil(SHARD * math.sqrt(size.n))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(counts))
        for rows in batches:
            if not rows.num_rows:
                continue
            x, _ = _matrix(rows.column("vector"), kind, width)
            own, node = rows.column("list").to_numpy().astype(np.int64), rows.column("node").to_numpy()
            part = shards.part(own, node)
            home = shards.first[own] + np.where(shards.parts[own] > 1, part, 0)
            meets = model.value.probed(x, own, every)
            for lo in range(0, rows.num_rows, 64):
                who, shard = [], []
                for i in range(lo, min(lo + 64, rows.num_rows)):
                    goes = {int(home[i])}
                    for c in np.flatnonzero(meets[i]).tolist():
                        parts = np.arange(shards.parts[c])
                        if c == own[i]:
                            parts = parts[turn(part[i], parts)]
                        goes.update((shards.first[c] + parts).tolist())
                    shard += sorted(goes)
                    who += [i] * len(goes)
                at = pa.array(who)
                is_home = np.array(shard) == home[who]
                columns = {f.name: rows.column(f.name).take(at) for f in INDEX}
                for c in ("codes", "err"):
                    values = columns[c].to_pylist()
                    columns[c] = [v if h else None for v, h in zip(values, is_home.tolist(), strict=True)]
                yield batch(DEALT, {"shard": shard, "home": is_home, "part": part[who], **columns})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: list[pa.RecordBatch] = []
        held: Held | None = None

        def take(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
            x, dims = _matrix(rows.column("vector"), kind, width)
            return x, dims, {c: rows.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "list", "part")}

        def opened() -> Held:
            x, dims, rows = take(pa.Table.from_batches(homes).combine_chunks().to_batches()[0])
            every = pa.Table.from_batches(homes)
            rows["err"] = every.column("err").to_numpy()
            rows["codes"] = np.stack([np.frombuffer(c, dtype=np.uint8) for c in every.column("codes").to_pylist()])
            return Held(model.value, x, dims, rows, cosine)

        def ends(held: Held) -> Iterator[pa.RecordBatch]:
            # what is held here also meets what is held here
            for lo in range(0, len(held.node), 512):
                s = slice(lo, lo + 512)
                yield batch(FOUND, held.probe(held.x[s], held.dims[s], held.node[s], held.n[s], held.list[s], held.part[s]))
            some = np.flatnonzero(held.count)
            yield batch(FOUND, {"a": held.node[some], "b": [None] * len(some), "n": held.count[some]})

        for rows in batches:
            is_home = rows.column("home")
            own = rows.filter(is_home)
            if own.num_rows:
                homes.append(own)
            other = rows.filter(pc.invert(is_home))
            if other.num_rows and homes:
                held = held or opened()
                x, dims, r = take(other)
                yield batch(FOUND, held.probe(x, dims, r["node"], r["n"], r["list"], r["part"]))
        if homes:
            yield from ends(held or opened())

    dealt = indexed.mapInArrow(deal, f"shard int, home boolean, part int, {ddl}")
    found = dealt.repartitionById(shards.number, "shard").sortWithinPartitions(F.desc("home"), "node")
    return materialise(found.mapInArrow(search, "a long, b long, n long"), "pq-found")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    rows, classes = classes_of(vectors)
    found = links(classes, cosine)
    alone = rows.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is not None:
        counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
        roots = components(found.where("b is not null").select("a", "b"), "pq")
        placed = materialise(
            classes.drop("vector").join(counts, "node", "left").join(roots, "node", "left").select(
                "k1", "k2", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "node").alias("class"),
            ),
            "pq-placed",
        )
        lowest = placed.groupBy("class").agg(F.min("low").alias("component_id"))
        named = placed.join(lowest, "class").select("k1", "k2", "n_links", "component_id")
        alone = rows.where("k1 is not null").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id").union(alone)
    return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: All pairs in SQL, for the small table of the correctness run.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), fit AS (
  SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM fit a JOIN fit b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT r, vec_id, r AS at FROM v
  UNION
  SELECT reach.r, reach.vec_id, p.b FROM reach JOIN pairs p ON p.a = reach.at
), low AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.at GROUP BY reach.r)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = v.r) AS n_links, component_id,
  coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN low USING (r)
"""
