"""Resampling of documents towards a target distribution, ranked by parallel sorting by regular sampling.

Weights. Words are runs of letters a-z, digits and characters beyond ASCII; A-Z are
lower-cased. Features are runs of 1 to ``ORDER`` consecutive words and fall in one of
``BUCKETS`` buckets by crc32. A bucket's gain compares its share of the target's
features with its share of the corpus's, both smoothed by one; a document's weight is
the floored mean of the gains of its features. Gumbel noise keyed by document makes the
highest scores a draw without replacement.

Ranks. Every task sorts its rows into a run and numbers them. Each run gives rows at
regular steps; of these, sorted, every k-th is a splitter. Splitters cut every run into
segments. Counts by segment, added up, say which segments hold drawn rows; only those
are exchanged, one segment to a task, sorted there and numbered on from the count of all
segments before. A run gives at most ``RUNS`` rows and there are at most ``RUNS`` runs,
so at most ``RUNS``**2 narrow rows of samples exist; only ``RUNS`` splitters reach the
driver. The last part of the key is the row's place in its run, so no two keys are equal
and a segment holds about a run's worth of rows, however many scores or rows repeat.

Null text has no words and weight 0. A null doc_id counts as the empty string for the
noise and comes last among equal scores. Repeated rows are ranked one by one. Very long
texts are read whole, one at a time. An empty table gives an empty result, an empty
target gains by the same formula. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import batch, documents, small_batches
from murmur.session import materialise

ORDER = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Sorted runs at most, and rows that each gives as samples.
RUNS = 512

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCORED = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])
COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
RANKED = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "weight", "score", "rank")])


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def buckets_of(words: list[bytes], order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every feature, repeats included."""
    found = [crc32(w) for w in words]
    for n in range(2, order + 1):
        found += [crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return np.array(found, dtype=np.int64) % buckets


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, the same for a document in every run."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket in thousandths, from the counts of both sides."""
    size = len(corpus)
    s, t = float(corpus.sum() + size), float(target.sum() + size)
    return np.array(
        [math.floor(1000 * math.log((float(b + 1) * s) / (float(a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)],
        dtype=np.int64,
    )


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket; ``texts`` has one column. Tasks send sums of their rows."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for rows in batches:
            for text in rows.column(0):
                total += np.bincount(buckets_of(words_of(text.as_py()), order, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield batch(COUNTS, {"bucket": some, "n": total[some]})

    # one row a bucket at most comes back
    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def scored(docs: DataFrame, gains: np.ndarray, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row."""
    small_batches(docs.sparkSession)
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column(0).to_pylist()
            out: dict[str, list] = {f.name: [] for f in SCORED}
            for i, text in zip(ids, rows.column(1), strict=True):
                words = words_of(text.as_py())
                found = buckets_of(words, order, buckets)
                weight = int(gains[found].sum()) // len(found) if len(found) else 0
                for name, value in zip(out, (i, len(words), len(found), weight, weight + noise(i, seed)), strict=True):
                    out[name].append(value)
            yield batch(SCORED, out)

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def sorted_runs(rows: DataFrame, runs: int = RUNS) -> DataFrame:
    """``rows`` as locally sorted runs in the shared folder; ``place`` is run * 2**33 + position."""
    # the key as whole numbers that ascend: best score first, then the smaller id, null last
    keyed = rows.select("*", (-F.col("score")).alias("k1"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("k2"))
    ordered = keyed.coalesce(runs).sortWithinPartitions("k1", "k2")
    return materialise(ordered.withColumn("place", F.monotonically_increasing_id()), "resample-runs")


def _run(place: Column) -> Column:
    return F.shiftright(place, 33)


def _position(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 33) - 1))


def splitters(runs: DataFrame) -> list[tuple[int, int, int]]:
    """Keys that cut all runs into about as many segments as there are runs, from their regular samples."""
    sizes = runs.groupBy(_run(F.col("place")).alias("run")).agg(F.count("*").alias("n"))
    parts = sizes.count()
    if parts < 2:
        return []
    step = F.ceil(F.col("n") / parts).cast("long")
    samples = (
        runs.select("k1", "k2", "place", _run(F.col("place")).alias("run"))
        .join(sizes, "run")
        .where(_position(F.col("place")) % step == F.floor(step / 2))
        .select("k1", "k2", "place")
    )
    # the samples are parts**2 narrow rows at most; every parts-th of them is a splitter
    numbered = samples.withColumn("at", F.row_number().over(Window.orderBy("k1", "k2", "place")))
    chosen = numbered.where(F.col("at") % parts == parts // 2).orderBy("at").collect()
    return [(r.k1, r.k2, r.place) for r in chosen]


def ranked(rows: DataFrame, draw: int | None = None, runs: int = RUNS) -> DataFrame:
    """``rows`` with the exact ``rank`` by score; beyond ``draw`` it is null.

    ``rows`` has doc_id, n_features, weight and score, all long.
    """
    spark: SparkSession = rows.sparkSession
    sorted_ = sorted_runs(rows, runs)
    cuts = splitters(sorted_)
    names = [f.name for f in RANKED][:-1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys = zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "place")), strict=True)
            segment = pa.array([bisect_right(cuts, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, segment], names=[*part.schema.names, "segment"])

    cut_ddl = ", ".join(f"{f.name} long" for f in sorted_.schema) + ", segment int"
    segments = sorted_.mapInArrow(cut, cut_ddl)
    counts = {r.segment: r.n for r in segments.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    before, last, total = [], 0, 0
    for k in range(len(cuts) + 1):
        before.append(total)
        total += counts.get(k, 0)
        if draw is None or before[k] < draw:
            last = k
    limit = total if draw is None else draw

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, at = None, 0
        for part in batches:
            if not part.num_rows:
                continue
            if segment is None:
                segment = part.column("segment")[0].as_py()
                at = before[segment]
            rank = np.arange(at + 1, at + part.num_rows + 1)
            at += part.num_rows
            yield batch(
                RANKED,
                {c: part.column(c) for c in names} | {"rank": pa.array(rank, mask=rank > limit)},
            )

    ddl = ", ".join(f"{f.name} long" for f in RANKED)
    drawn = (
        segments.where(F.col("segment") <= last)
        .repartitionById(last + 1, "segment")
        .sortWithinPartitions("k1", "k2", "place")
        .mapInArrow(number, ddl)
    )
    rest = segments.where(F.col("segment") > last).select(*names, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest) if last < len(cuts) else drawn


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least: int = MIN_WORDS,
    order: int = ORDER,
    buckets: int = BUCKETS,
    seed: int = SEED,
    runs: int = RUNS,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn) of every row.

    ``percent`` of the documents with ``least`` words are drawn. ``target`` has a
    column ``text``.
    """
    gains = gains_of(
        bucket_counts(documents(docs).select("text"), order, buckets),
        bucket_counts(target.select(F.col("text").cast("string").alias("text")), order, buckets),
    )
    rows = materialise(scored(docs, gains, order, seed), "resample-scored")
    columns = ["doc_id", "n_features", "weight", "score"]
    fit = rows.where(F.col("n_words") >= least)
    short = rows.where(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank"))
    draw = percent * fit.count() // 100
    return ranked(fit.select(*columns), draw, runs).unionByName(short)


#: The same rows in SQL; crc32 of each distinct word byte by byte with the usual table.
ORACLE = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), goal AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), used AS (SELECT r, doc_id, unnest(words) AS word FROM docs),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM used UNION SELECT word FROM goal)),
hashed AS (
  SELECT word, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
      lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc
), s AS (SELECT bucket, count(*) AS n FROM used JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM goal JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM used) AS s, (SELECT count(*) FROM goal) AS t),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + 10000)::DOUBLE
      / ((s.n + 1)::DOUBLE * (totals.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weights AS (
  SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM used JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r
), scores AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n FROM scores
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM placed
"""
