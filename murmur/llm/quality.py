"""Quality classifier: a byte-level convolutional network in numpy.

Overlapping chunks of ``CHUNK`` bytes cover the whole document. Learned filters
over ``WIDTH`` neighbouring byte vectors are max-pooled within each chunk; the
chunk values are averaged over the document, joined by two sizes (how full the
chunks are, and the logarithm of the length), and combined into one probability
that the label is 1.

Learning uses a bounded sample of labelled rows outside the held-out fold: about
``TRAIN_DOCS`` documents, chosen by a hash of the id, and ``TRAIN_CHUNKS`` hashed
chunks of each. All rows are scored whole.

Null and empty texts are one empty chunk and get a score like any text. A
document with several labels counts as 1 if their mean is at least one half. With
nothing to learn from, every score is 0.5. A null id is never learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import batch, in_fold, small_batches
from murmur.llm.language import adam

FOLDS, HELD_OUT = 5, 0
TRAIN_DOCS = 4000
TRAIN_CHUNKS = 3
CHUNK = 512
OVERLAP = 32
WIDTH = 6
DEPTH = 4
FILTERS = 16
#: Chunks convolved at a time.
BLOCK = 32
THRESHOLD = 0.3

SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
)


def chunks_of(text: str | None) -> np.ndarray:
    """Bytes of a text in overlapping rows; byte 0 fills the last, and an empty text is one row."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    stride = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(data) - OVERLAP) // stride))
    flat = np.zeros((n - 1) * stride + CHUNK, dtype=np.uint8)
    flat[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::stride]


def sizes(length: int, n_chunks: int) -> tuple[float, float]:
    return length / (n_chunks * CHUNK), np.log1p(length) / 10


@dataclass
class Cnn:
    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 1) -> Cnn:
        rng = np.random.default_rng(seed)
        w = {
            "bytes": rng.normal(0, 0.5, (256, DEPTH)),
            "filters": rng.normal(0, 1 / np.sqrt(WIDTH * DEPTH), (WIDTH * DEPTH, FILTERS)),
            "shift": np.zeros(FILTERS),
            "out": rng.normal(0, 0.1, FILTERS + 2),
            "bias": np.zeros(1),
        }
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """(chunks, positions, width * depth) byte vectors side by side."""
        vectors = self.w["bytes"][rows].reshape(len(rows), -1)
        view = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH * DEPTH, axis=1)
        return view[:, ::DEPTH]

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter value of each chunk, and where it is."""
        windows = np.ascontiguousarray(self.windows(rows))
        n, places, width = windows.shape
        values = (windows.reshape(-1, width) @ self.w["filters"]).reshape(n, places, -1)
        where = values.argmax(axis=1)
        top = np.take_along_axis(values, where[:, None], axis=1)[:, 0]
        return np.tanh(top + self.w["shift"]), where

    def largest(self, rows: np.ndarray) -> np.ndarray:
        """Pooled values alone, block by block."""
        out = np.empty((len(rows), FILTERS), dtype=np.float32)
        for lo in range(0, len(rows), BLOCK):
            windows = np.ascontiguousarray(self.windows(rows[lo : lo + BLOCK]))
            n, places, width = windows.shape
            values = (windows.reshape(-1, width) @ self.w["filters"]).reshape(n, places, -1)
            out[lo : lo + BLOCK] = values.max(axis=1)
        return np.tanh(out + self.w["shift"])

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        parts = [chunks_of(t) for t in texts]
        counts = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(texts)), counts)
        values = np.zeros((len(texts), FILTERS))
        np.add.at(values, owner, self.largest(np.concatenate(parts)) if parts else np.zeros((0, FILTERS)))
        more = np.array([sizes(len((t or "").encode()), len(p)) for t, p in zip(texts, parts, strict=True)])
        features = np.concatenate([values / counts[:, None], more.reshape(-1, 2)], axis=1)
        return 1 / (1 + np.exp(-(features @ self.w["out"] + self.w["bias"][0])))

    def gradient(self, rows: np.ndarray, owner: np.ndarray, more: np.ndarray, labels: np.ndarray):
        """Loss and gradients; only the places that won the pooling carry any back."""
        n = len(labels)
        counts = np.bincount(owner, minlength=n)
        values, where = self.pooled(rows)
        mean = np.zeros((n, FILTERS), dtype=np.float32)
        np.add.at(mean, owner, values)
        features = np.concatenate([mean / counts[:, None], more], axis=1).astype(np.float32)
        p = 1 / (1 + np.exp(-(features @ self.w["out"] + self.w["bias"][0])))
        loss = -float(np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-9)))
        d = ((p - labels) / n).astype(np.float32)
        grads = {"out": features.T @ d, "bias": np.array([d.sum()], dtype=np.float32)}
        top = d[:, None] * self.w["out"][:FILTERS] / counts[:, None]
        top = top[owner] * (1 - values * values)
        grads["shift"] = top.sum(axis=0)
        won = self.windows(rows)[np.arange(len(rows))[:, None], where]
        grads["filters"] = np.einsum("nkw,nk->wk", won, top)
        back = np.einsum("nk,wk->nkw", top, self.w["filters"]).reshape(-1, DEPTH)
        at = where[:, :, None] + np.arange(WIDTH)
        letters = rows[np.arange(len(rows))[:, None, None], at].reshape(-1)
        grads["bytes"] = np.zeros_like(self.w["bytes"])
        np.add.at(grads["bytes"], letters, back)
        return loss, grads


def train(
    rows: np.ndarray, owner: np.ndarray, more: np.ndarray, labels: np.ndarray,
    steps: int = 400, size: int = 64, seed: int = 1,
) -> Cnn:
    """``owner`` is ascending: the document of each chunk."""
    model, state = Cnn.fresh(seed), {}
    rng = np.random.default_rng(seed)
    first = np.searchsorted(owner, np.arange(len(labels)))
    after = np.searchsorted(owner, np.arange(len(labels)), side="right")
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < size:
            order += rng.permutation(len(labels)).tolist()
        pick, order = order[:size], order[size:]
        index = np.concatenate([np.arange(first[i], after[i]) for i in pick])
        own = np.repeat(np.arange(len(pick)), after[pick] - first[pick])
        _, grads = model.gradient(rows[index], own, more[pick], labels[pick])
        adam(model.w, grads, state, 0.02 * (1 - step / (steps + 1)), step)
    return model


def training_chunks(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, chunks: int = TRAIN_CHUNKS):
    """Bounded sample: chunks, their document's number, sizes and labels."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
        .where("doc_id is not null and q is not null")
        .groupBy("doc_id")
        .agg((F.avg("q") >= 0.5).cast("int").alias("label"))
        .where(~in_fold("doc_id", FOLDS, HELD_OUT))
    )
    marks = marks.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {"doc_id": [], "label": [], "part": [], "fill": [], "len": []}
            for doc_id, text, label in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True):
                whole = chunks_of(text)
                a, b = sizes(len((text or "").encode()), len(whole))
                picked = sorted({zlib.crc32(f"{doc_id}/{s}".encode()) % len(whole) for s in range(chunks)})
                values = (doc_id, label, whole[picked].tobytes(), a, b)
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("part", pa.binary()),
                                       ("fill", pa.float64()), ("len", pa.float64())])
            )

    sample = texts.join(marks, "doc_id").select("doc_id", "text", "label").mapInArrow(
        cut, "doc_id long, label int, part binary, fill double, len double"
    )
    # repeated ids are possible, so the bound is set again
    rows = sample.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "part").limit(limit).collect()
    parts = [np.frombuffer(r.part, dtype=np.uint8).reshape(-1, CHUNK) for r in rows]
    if not parts:
        return None
    return (
        np.concatenate(parts),
        np.repeat(np.arange(len(parts)), [len(p) for p in parts]),
        np.array([(r.fill, r.len) for r in rows], dtype=np.float32),
        np.array([r.label for r in rows]),
    )


def fit(docs: DataFrame, labels: DataFrame) -> Cnn:
    sample = training_chunks(docs, labels)
    if sample is None:
        model = Cnn.fresh()
        model.w["out"][:] = 0
        return model
    return train(*sample)


def score(docs: DataFrame, labels: DataFrame, model: Cnn | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``."""
    model = model or fit(docs, labels)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            p = np.clip(model.probabilities(rows.column("text").to_pylist()), 0, 1)
            yield batch(
                SCORES,
                {"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "score": p.astype(float),
                 "predicted": (p >= threshold).astype(np.int32)},
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        in_fold(F.col("doc_id").cast("long"), FOLDS, HELD_OUT).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
