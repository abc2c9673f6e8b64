"""Language identification: a bidirectional gated recurrent network over bytes.

The network (numpy, trained by backpropagation through time and Adam) reads the
bytes of the lower-cased text in spans of ``SPAN`` bytes, forwards and backwards,
and gives every byte position a distribution over the languages. The document's
distribution is the mean over all its positions; nothing is cut off.

Learning uses a bounded sample of labelled rows outside the held-out fold: at
most ``PER_LANGUAGE`` documents a language (those with the smallest hash of id
and length) and ``SPANS`` spans of each, at hashed places. All rows are scored.

Null texts and texts without a letter are ``und`` with score 1. Repeated rows get
equal rows. With nothing to learn from, every text with letters is ``und`` with
score 0. A null id is never learned from and never held out.
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
from murmur.session import materialise

FOLDS, HELD_OUT = 4, 2
PER_LANGUAGE = 500
SPANS = 4
SPAN = 128
HIDDEN = 8
#: Spans that run through the network side by side.
BLOCK = 2048
#: More languages than this are refused.
LANGUAGES = 256
UNKNOWN = "und"
#: Documents whose best language has less than this are rejected by the filter.
SURE = 0.4

PREDICTIONS = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode(), dtype=np.uint8)


def spans_of(texts: list[np.ndarray], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in rows of ``span`` bytes: bytes, used length, and text number of each row."""
    counts = np.array([-(-len(t) // span) for t in texts], dtype=np.int64)
    rows = np.zeros((int(counts.sum()), span), dtype=np.uint8)
    used = np.full(len(rows), span, dtype=np.int64)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        if n:
            rows.reshape(-1)[at * span : at * span + len(text)] = text
            at += n
            used[at - 1] = len(text) - (n - 1) * span
    return rows, used, np.repeat(np.arange(len(texts)), counts)


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray, k: int):
    """One gated step. Gates are (1 + tanh) / 2; ``x`` is what the byte adds."""
    g = h @ u
    zr = 0.5 * np.tanh(x[:, : 2 * k] + g[:, : 2 * k]) + 0.5
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
    return n + z * (h - n), z, r, n, g


@dataclass
class Gru:
    """Weights by name; ``f`` and ``b`` mark the two directions."""

    languages: list[str]
    w: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.w["uf"].shape[0]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Gru:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"p{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            w[f"u{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden))
            w[f"o{d}"] = rng.normal(0, 0.3, (hidden, len(languages)))
        w["o"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def _positions(self, rows: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Sum over the used positions of each row's distribution."""
        k, (n, span) = self.hidden, rows.shape
        forward = np.empty((span, n, k), dtype=np.float32)
        h = np.zeros((n, k), dtype=np.float32)
        columns = np.ascontiguousarray(rows.T)
        for t in range(span):
            h = _step(self.w["pf"][columns[t]], h, self.w["uf"], k)[0]
            forward[t] = h
        h = np.zeros((n, k), dtype=np.float32)
        total = np.zeros((n, len(self.languages)), dtype=np.float64)
        shortest = int(used.min()) if n else span
        for t in range(span - 1, -1, -1):
            h = _step(self.w["pb"][columns[t]], h, self.w["ub"], k)[0]
            p = np.exp(np.clip(forward[t] @ self.w["of"] + h @ self.w["ob"] + self.w["o"], -30, 30))
            p /= p.sum(axis=1, keepdims=True)
            if t >= shortest:
                inside = (used > t)[:, None]
                h *= inside
                p *= inside
            total += p
        return total

    def probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        """Mean distribution of every text; zero for empty ones."""
        rows, used, owner = spans_of(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(rows), BLOCK):
            part = slice(lo, lo + BLOCK)
            np.add.at(out, owner[part], self._positions(rows[part], used[part]))
        return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]

    def gradient(self, rows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time, all positions labelled alike."""
        k, w, (n, span) = self.hidden, self.w, rows.shape
        columns = rows.T
        kept = {}
        for d, order in (("f", range(span)), ("b", range(span - 1, -1, -1))):
            h, states = np.zeros((n, k), dtype=np.float32), [None] * span
            for t in order:
                before = h
                h, z, r, c, g = _step(w[f"p{d}"][columns[t]], h, w[f"u{d}"], k)
                states[t] = (before, h, z, r, c, g)
            kept[d] = states
        grads = {name: np.zeros_like(v) for name, v in w.items()}
        hf, hb = (np.stack([s[1] for s in kept[d]]) for d in "fb")
        logits = hf @ w["of"] + hb @ w["ob"] + w["o"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        loss = -float(np.log(p[:, np.arange(n), labels] + 1e-9).mean())
        p[:, np.arange(n), labels] -= 1
        p /= n * span
        grads["o"] = p.sum(axis=(0, 1))
        for d, states, own in (("f", hf, range(span - 1, -1, -1)), ("b", hb, range(span))):
            grads[f"o{d}"] = np.einsum("tnk,tnc->kc", states, p)
            above, carry, u = p @ w[f"o{d}"].T, np.zeros((n, k), dtype=np.float32), w[f"u{d}"]
            for t in own:
                before, _, z, r, c, g = kept[d][t]
                dh = above[t] + carry
                dz = dh * (before - c) * 2 * z * (1 - z)
                dc = dh * (1 - z) * (1 - c * c)
                dr = dc * g[:, 2 * k :] * 2 * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                grads[f"u{d}"] += before.T @ dg
                carry = dh * z + dg @ u.T
                np.add.at(grads[f"p{d}"], columns[t], dx)
        return loss, grads


def adam(weights: dict, grads: dict, state: dict, rate: float, step: int) -> None:
    for name, g in grads.items():
        m, v = state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        weights[name] -= (
            rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        ).astype(np.float32)


def train(
    rows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 500, size: int = 128, seed: int = 1
) -> Gru:
    model, state = Gru.fresh(languages, seed=seed), {}
    rng = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(rows), size)
        _, grads = model.gradient(rows[pick], labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        if norm > 1:
            grads = {k: g / norm for k, g in grads.items()}
        adam(model.w, grads, state, 0.02 * (1 - step / (steps + 1)), step)
    return model


def training_spans(
    docs: DataFrame, per_language: int = PER_LANGUAGE, spans: int = SPANS, span: int = SPAN // 2
) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Bounded sample: at most ``per_language * spans`` rows a language reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & ~in_fold("doc_id", FOLDS, HELD_OUT)
    )
    keys = usable.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id", F.lit(5)))
    languages = sorted(r.lang for r in keys.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not languages:
        return np.zeros((0, span), np.uint8), np.zeros(0, np.int64), []
    # the hash below which about twice enough rows of each language lie, from exact counts
    counts = {r.lang: r["count"] for r in keys.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * per_language / counts[lang]))).otherwise(share)
    chosen = usable.withColumn("h", F.xxhash64("doc_id", F.lit(5))).where(
        F.col("h") < (F.lit(-(2.0**63)) + share * F.lit(2.0**64))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lang, part, order = [], [], []
            for doc_id, text, name in zip(*(c.to_pylist() for c in rows.columns[:3]), strict=True):
                if not has_letter(text):
                    continue
                data = as_bytes(text)
                for s in range(spans if len(data) > span else 1):
                    at = zlib.crc32(f"{doc_id}/{s}".encode()) % max(1, len(data) - span + 1)
                    piece = np.zeros(span, dtype=np.uint8)
                    some = data[at : at + span]
                    piece[: len(some)] = some
                    lang.append(name)
                    part.append(piece.tobytes())
                    order.append(zlib.crc32(f"{s}/{doc_id}".encode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(part, pa.binary()), pa.array(order, pa.int64())],
                names=["lang", "part", "ord"],
            )

    # one scan of the texts; what it leaves is some multiple of the sample
    parts = materialise(chosen.mapInArrow(cut, "lang string, part binary, ord long"), "language-spans")
    got = []
    for lang in languages:
        top = parts.where(F.col("lang") == lang).orderBy("ord", "part").limit(per_language * spans)
        got.append(top)
    whole = got[0]
    for more in got[1:]:
        whole = whole.unionByName(more)
    rows = sorted((r.lang, r.ord, bytes(r.part)) for r in whole.collect())
    data = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(-1, span)
    labels = np.array([languages.index(r[0]) for r in rows], dtype=np.int64)
    return data, labels, languages


def balanced(labels: np.ndarray, seed: int = 1) -> np.ndarray:
    """Row numbers in which every label occurs equally often."""
    rng = np.random.default_rng(seed)
    most = np.bincount(labels).max()
    return np.concatenate(
        [rng.choice(np.flatnonzero(labels == c), most) for c in np.unique(labels)]
    )


def fit(docs: DataFrame) -> Gru:
    rows, labels, languages = training_spans(docs)
    if not len(rows):
        return Gru.fresh([])
    pick = balanced(labels)
    return train(rows[pick], labels[pick], languages)


def judged(model: Gru, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of every text."""
    known = [has_letter(t) for t in texts]
    guess, score = [UNKNOWN] * len(texts), [0.0 if k else 1.0 for k in known]
    if model.languages and any(known):
        p = model.probabilities([as_bytes(t) if k else as_bytes("") for t, k in zip(texts, known, strict=True)])
        best = p.argmax(axis=1)
        for i in np.flatnonzero(known).tolist():
            guess[i] = model.languages[best[i]]
            score[i] = min(1.0, max(0.0, float(p[i, best[i]])))
    return guess, score


def keep(docs: DataFrame, model: Gru | None = None, sure: float = SURE) -> DataFrame:
    """Rows of ``docs``, as they are, whose language is recognised with a score of ``sure``."""
    model = model or fit(docs)
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            guess, score = judged(model, rows.column(at).to_pylist())
            good = [g != UNKNOWN and s >= sure for g, s in zip(guess, score, strict=True)]
            yield rows.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: Gru | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    model = model or fit(docs)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            guess, score = judged(model, rows.column("text").to_pylist())
            yield batch(
                PREDICTIONS,
                {"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "lang_pred": guess, "score": score},
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        in_fold(F.col("doc_id").cast("long"), FOLDS, HELD_OUT).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
