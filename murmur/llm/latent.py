"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of at most ``PASSAGE`` words (half
   overlapping). Their terms are weighted by TF-IDF, with document frequencies
   counted over all documents. Common terms weigh little, but no term weighs
   nothing: a passage copied into very many documents is made of common terms.
2. A randomised SVD of the passage matrix (two power iterations) gives a latent
   space that is cut off where it holds ``ENERGY`` of the squared lengths, at
   ``RANK`` dimensions at most; twice ``RANK`` passages share a space. Passages of
   which the space keeps less than ``KEPT`` (squared) would be lost in it: their own
   directions are added while there is room, and what is lost still moves on to
   the next space, so each is searched for where it shows. Every product
   with the matrix is a Spark job over passages: tasks multiply their rows, and
   partial sums are added up by block of terms. The driver only handles matrices
   of the size of the rank, and the term vectors of one block of items.
3. Every document is read whole: windows of ``WINDOW`` words, ``STRIDE`` apart,
   are folded into the space, and passages with a cosine of ``COSINE`` or more
   are candidates, if the window holds ``COVER`` of the passage's latent weight.
   Passages are bounded in ``GROUPS`` groups: a window is only folded if its terms,
   each at its most for any passage of a group, add up to that for some group.
4. A candidate counts if the longest common subsequence of passage and the words
   around the window covers ``SAME`` of the passage, or ``PARAPHRASE`` of it while
   the answer check holds: of the passage's ``ANSWER`` rarest words and the words
   of its last sentence, at least ``ANSWERED`` lie in the matched stretch. The
   stretch may be at most ``LOOSE`` times as long as the passage.

Benchmarks larger than ``BLOCK_CHARS`` are worked through in blocks of items, so
what is sent to tasks is bounded. Passages with fewer than ``SHORT`` words
are searched for as whole runs of words instead.

Words are lower-cased runs between white space and ASCII punctuation. Null and
empty texts or items match nothing. Repeated rows give repeated hits; equal items
all hit. Null ids stay null. Without items there are no hits.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import batch, documents, small_batches

PASSAGE = 64
WINDOW = 32
STRIDE = 8
RANK = 256
ENERGY = 0.8
KEPT = 0.5
OVERSAMPLE = 16
POWER = 2
COSINE = 0.35
COVER = 0.3
SAME = 0.8
PARAPHRASE = 0.6
ANSWER = 6
ANSWERED = 0.8
LOOSE = 1.5
SHORT = 8
BLOCK_CHARS = 1_000_000
#: Terms whose partial sums travel in one row.
TERMS = 256
#: Groups of passages that a window's weight is bounded for before it is folded.
GROUPS = 16

_SPLIT = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPLIT).split()


@dataclass
class Passage:
    item_id: int | None
    words: list[bytes]
    last: frozenset
    counts: dict[bytes, int]


def passages_of(item_id, text: str | None) -> list[Passage]:
    """Half-overlapping passages; ``last`` holds the words of the item's last sentence."""
    words = words_of(text)
    if not words:
        return []
    sentences = [s for s in map(words_of, (text or "").replace("?", ".").replace("!", ".").split(".")) if s]
    starts = [0] if len(words) <= PASSAGE else list(range(0, len(words) - PASSAGE // 2, PASSAGE // 2))
    out = []
    for s in starts:
        part = words[s : s + PASSAGE]
        ends = s + PASSAGE >= len(words)
        last = frozenset(sentences[-1]) if ends and sentences else frozenset()
        out.append(Passage(item_id, part, last, dict(Counter(part))))
    return out


def frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""
    small_batches(docs.sparkSession)
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        known = number.keys()
        for rows in batches:
            for text in rows.column(1).to_pylist():
                counts[-1] += 1
                counts.update(map(number.__getitem__, known & set(words_of(text))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"]
        )

    found = documents(docs).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out, total = np.zeros(len(terms)), 0
    for r in found.collect():
        if r.term < 0:
            total = r.n
        else:
            out[r.term] = r.n
    return out, total


def _rows(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for ids, weights in zip(part["ids"], part["weights"], strict=True):
        yield np.asarray(ids, dtype=np.int64), np.asarray(weights, dtype=np.float64)


def transposed_product(matrix: DataFrame, right: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """``A' A right`` (or ``A' A right left``): one pass over the rows of A, summed by block of terms."""
    n_terms, width = right.shape
    if left is not None:
        right = right @ left

    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_terms, width))
        for part in parts:
            for ids, weights in _rows(part):
                total[ids] += np.outer(weights, weights @ right[ids])
        blocks = range(0, n_terms, TERMS)
        yield pd.DataFrame(
            {"block": [lo // TERMS for lo in blocks], "sums": [total[lo : lo + TERMS].tobytes() for lo in blocks]}
        )

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, dtype=np.float64) for b in part["sums"])
        return pd.DataFrame({"block": [key[0]], "sums": [total.tobytes()]})

    sums = matrix.mapInPandas(multiply, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary")
    out = np.zeros((n_terms, width))
    for r in sums.collect():
        out[r.block * TERMS : (r.block + 1) * TERMS] = np.frombuffer(bytes(r.sums), dtype=np.float64).reshape(-1, width)
    return out


def randomised_svd(
    matrix: DataFrame, n_terms: int, n_rows: int, rank: int = RANK, energy: float = 1.0, seed: int = 7
) -> np.ndarray:
    """Right singular vectors (terms by rank) of the distributed rows (ids, weights).

    Of rows of length one, as few as hold the share ``energy`` of the squared lengths.
    """
    width = min(rank + OVERSAMPLE, n_terms, n_rows)
    basis = np.random.default_rng(seed).normal(size=(n_terms, width))
    for _ in range(POWER):
        basis, _ = np.linalg.qr(transposed_product(matrix, basis))
    # within the found subspace: Rayleigh-Ritz on A'A
    product = transposed_product(matrix, basis)
    values, vectors = np.linalg.eigh(basis.T @ product)
    keep = np.argsort(values)[::-1][: min(rank, width)]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-300)]
    if energy < 1:
        keep = keep[: int(np.searchsorted(np.cumsum(values[keep]), energy * n_rows)) + 1]
    return basis @ vectors[:, keep]


@dataclass
class Space:
    """Term vectors (with their weights), and the directions and lengths of its passages."""

    fold: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    which: np.ndarray
    #: By term and group of passages, the largest share of a passage's weight that one occurrence adds.
    #: The last row is that of all other words, which add nothing.
    most: np.ndarray


@dataclass
class Index:
    """What a task needs to search one block of the benchmark."""

    number: dict[bytes, int]
    idf: np.ndarray
    passages: list[Passage]
    spaces: list[Space]
    plain: list[int]


def vector(ids: list[int], idf: np.ndarray) -> tuple[list[int], list[float]]:
    counts = Counter(ids)
    return list(counts), [n * float(idf[i]) for i, n in counts.items()]


def weights(docs: DataFrame, terms: list[bytes]) -> np.ndarray:
    """Inverse document frequencies, at least 1."""
    seen, total = frequencies(docs, terms)
    return np.log((total + 1) / (seen + 1)) + 1


def build(docs: DataFrame, passages: list[Passage], rank: int = RANK, energy: float = ENERGY) -> Index:
    spark = docs.sparkSession
    terms = sorted({w for p in passages for w in p.words})
    idf = weights(docs, terms)
    number = {t: i for i, t in enumerate(terms)}
    rows = [vector([number[w] for w in p.words], idf) for p in passages]
    usable = [i for i, p in enumerate(passages) if len(p.words) >= SHORT]
    plain = sorted(set(range(len(passages))) - set(usable))
    spaces = []
    unit = {i: np.asarray(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in usable}

    def directions(some: list[int], energy: float, most: int) -> np.ndarray:
        matrix = spark.createDataFrame(
            [(rows[i][0], unit[i].tolist()) for i in some], "ids array<int>, weights array<double>"
        )
        return randomised_svd(matrix, len(terms), len(some), most, energy)

    def kept(some: list[int], right: np.ndarray) -> np.ndarray:
        return np.array([np.linalg.norm(unit[i] @ right[rows[i][0]]) ** 2 for i in some])

    left = usable
    while left:
        chunk, left = left[: 2 * rank], left[2 * rank :]
        right = directions(chunk, energy, rank)
        shares = kept(chunk, right)
        if not (shares >= KEPT).any():
            # too many unlike passages for one space: fewer, with a direction each
            chunk, left = chunk[:rank], chunk[rank:] + left
            right = directions(chunk, 1.0, rank)
            shares = kept(chunk, right)
        while (shares < KEPT).any() and right.shape[1] < rank:
            lost = [i for i, share in zip(chunk, shares, strict=True) if share < KEPT]
            more = directions(lost, energy, rank - right.shape[1])
            # what the space holds already adds nothing
            for _ in range(2):
                more = more - right @ (right.T @ more)
            right = np.hstack([right, np.linalg.qr(more)[0]])
            shares = kept(chunk, right)
        some = [i for i, share in zip(chunk, shares, strict=True) if share >= KEPT]
        left = [i for i, share in zip(chunk, shares, strict=True) if share < KEPT] + left
        vectors = np.array([np.asarray(rows[i][1]) @ right[rows[i][0]] for i in some])
        norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        fold = idf[:, None] * right
        shares = (vectors / norms[:, None] ** 2).T
        # neighbouring passages, which are of one item or of items written alike, share a group
        heads = np.unique(np.arange(GROUPS) * len(some) // GROUPS)
        most = np.zeros((len(fold) + 1, len(heads)), dtype=np.float32)
        for at in range(0, len(fold), 4096):
            most[at : at + 4096][: len(fold) - at] = np.maximum.reduceat(fold[at : at + 4096] @ shares, heads, axis=1)
        spaces.append(
            Space(
                fold.astype(np.float32),
                (vectors / norms[:, None]).astype(np.float32),
                norms.astype(np.float32),
                np.array(some),
                most,
            )
        )
    return Index(number, idf, passages, spaces, plain)


def candidates(space: Space, ids: np.ndarray) -> list[tuple[int, int, float]]:
    """(passage, first word of a window, cosine) with a cosine of ``COSINE`` or more that also cover enough."""
    # sums by stride; a window is a run of them. The first windows begin before the text
    reach = WINDOW // STRIDE
    n_cells = -(-len(ids) // STRIDE)
    padded = np.full(n_cells * STRIDE, -1, dtype=ids.dtype)
    padded[: len(ids)] = ids
    # no passage has more of its weight in a window than the most that the terms can add for its group
    sums = np.zeros((n_cells + 2 * reach - 2, space.most.shape[1]), dtype=np.float32)
    for at in range(0, n_cells, 4096):
        part = space.most[padded[at * STRIDE : (at + 4096) * STRIDE]]
        sums[reach - 1 + at :][: len(part) // STRIDE] = part.reshape(-1, STRIDE, part.shape[1]).sum(axis=1)
    most = sums[: n_cells + reach - 1].copy()
    for d in range(1, reach):
        most += sums[d : d + n_cells + reach - 1]
    begin = np.flatnonzero(most.max(axis=1) >= COVER - 1e-3) - (reach - 1)
    if not len(begin):
        return []
    edge = np.zeros(n_cells + reach, dtype=np.int64)
    np.add.at(edge, np.maximum(begin, 0), 1)
    np.add.at(edge, begin + reach, -1)
    needed = np.cumsum(edge)[:n_cells] > 0
    heavy = np.flatnonzero((padded >= 0) & np.repeat(needed, STRIDE))
    cell, first = np.unique(heavy // STRIDE, return_index=True)
    lo, hi = np.searchsorted(cell, begin), np.searchsorted(cell, begin + reach)
    sums = np.add.reduceat(space.fold[ids[heavy]], first, axis=0)
    run = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
    windows = (run[hi] - run[lo]).astype(np.float32)
    norms = np.linalg.norm(windows, axis=1)
    # too light for any passage's share, whatever the direction
    solid = (norms > 1e-6) & (norms >= COVER * space.norms.min())
    begin, windows, norms = begin[solid], windows[solid], norms[solid]
    out = []
    for at in range(0, len(windows), 4096):
        weight = windows[at : at + 4096] @ space.vectors.T
        bar = np.maximum(COSINE * norms[at : at + 4096, None], COVER * space.norms[None])
        for w, p in zip(*np.nonzero(weight >= bar), strict=True):
            out.append((int(space.which[p]), int(begin[at + w]) * STRIDE, float(weight[w, p] / norms[at + w])))
    return out


def common_subsequence(a: list, b: list) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the stretch of ``b`` that holds one."""
    n, m = len(a), len(b)
    table = np.zeros((n + 1, m + 1), dtype=np.int32)
    code = {w: i for i, w in enumerate(dict.fromkeys(a))}
    left, right = np.array([code[w] for w in a]), np.array([code.get(w, -1) for w in b])
    for i in range(1, n + 1):
        step = np.maximum(table[i - 1, 1:], table[i - 1, :-1] + (right == left[i - 1]))
        table[i, 1:] = np.maximum.accumulate(step)
    # the earliest end, and from there back along the latest matches: a short stretch
    length = table[n, m]
    last = int(np.argmax(table[n] == length))
    i, j, first = n, last, last
    while i and j and table[i, j]:
        if right[j - 1] == left[i - 1]:
            i, j = i - 1, j - 1
            first = j
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return int(table[n, m]), first, last


def verify(index: Index, p: int, words: list[bytes], start: int) -> tuple[float, bool, int] | None:
    """Share of the passage found around a window, the answer check, and where it begins."""
    passage = index.passages[p].words
    n = len(passage)
    lo, hi = max(0, start - n), min(len(words), start + WINDOW + n)
    near = words[lo:hi]
    # no subsequence is longer than the words in common
    there = Counter(near).get
    shared = sum(min(c, there(w, 0)) for w, c in index.passages[p].counts.items())
    if shared < PARAPHRASE * n:
        return None
    length, first, last = common_subsequence(passage, near)
    share = length / n
    if share < PARAPHRASE or last - first > LOOSE * n + 2:
        return None
    rare = sorted(set(passage), key=lambda w: (-index.idf[index.number[w]], w))[:ANSWER]
    wanted = set(rare) | index.passages[p].last & set(passage)
    answered = len(wanted & set(near[first:last])) >= ANSWERED * len(wanted)
    if share >= SAME or answered:
        return share, answered, lo + first
    return None


HITS = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("word", pa.int64()), ("cosine", pa.float64()),
     ("common_share", pa.float64()), ("answered", pa.bool_())]
)
HITS_DDL = "doc_id long, item_id long, word long, cosine double, common_share double, answered boolean"


def search_text(index: Index, text: str | None) -> list[tuple]:
    """The best verified hit of each item: (item, word, cosine, share, answered)."""
    words = words_of(text)
    if not words:
        return []
    get = index.number.get
    ids = np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words))
    hits: dict = {}
    tried: dict[int, set] = {}
    every = [c for space in index.spaces for c in candidates(space, ids)]
    for p, start, cosine in sorted(every, key=lambda c: (-c[2], c[:2])):
        spot = start // (2 * WINDOW)
        if spot in tried.setdefault(p, set()):
            continue
        found = verify(index, p, words, start)
        if found:
            tried[p].add(spot)
            item = index.passages[p].item_id
            row = (item, found[2], cosine, found[0], found[1])
            if item not in hits or (row[3], row[2], -row[1]) > (hits[item][3], hits[item][2], -hits[item][1]):
                hits[item] = row
    if index.plain:
        joined = b" " + b" ".join(words) + b" "
        for p in index.plain:
            at = joined.find(b" " + b" ".join(index.passages[p].words) + b" ")
            item = index.passages[p].item_id
            if at >= 0 and item not in hits:
                hits[item] = (item, joined[:at].count(b" "), 1.0, 1.0, True)
    return sorted(hits.values(), key=lambda h: (h[0] is None, h[0] or 0))


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[Passage]]:
    """Passages of the benchmark, in blocks of bounded size."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null and text <> ''")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_chars)
    # twice as many blocks as the size asks for leave room for uneven ones
    n = n if n <= 1 else 2 * n
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()
        found = [p for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text)) for p in passages_of(r.item_id, r.text)]
        if found:
            yield found


def search(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    for passages in blocks_of(benchmark, block_chars):
        index = build(docs, passages, rank)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                out: dict[str, list] = {f.name: [] for f in HITS}
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    for hit in search_text(index, text):
                        for name, value in zip(out, (doc_id, *hit), strict=True):
                            out[name].append(value)
                yield batch(HITS, out)

        found = documents(docs).mapInArrow(run, HITS_DDL)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], HITS_DDL) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs``, as they are, that hold no item."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    out = docs
    for passages in blocks_of(benchmark, block_chars):
        index = build(docs, passages, rank)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                good = [not search_text(index, t) for t in rows.column(at).to_pylist()]
                yield rows.filter(pa.array(good, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
