import zlib

import numpy as np
import pytest

from murmur.llm import quality, queries


def test_chunks_cover_the_text():
    for n in (0, 1, 31, 32, 33, 511, 512, 513, 992, 993, 5000):
        data = np.arange(n) % 200 + 1
        rows = quality.chunks_of(bytes(data.tolist()).decode("latin-1") if n == 0 else "a" * n)
        stride = quality.CHUNK - quality.OVERLAP
        seen = np.zeros((len(rows) - 1) * stride + quality.CHUNK, dtype=int)
        for i, row in enumerate(rows):
            seen[i * stride : i * stride + quality.CHUNK] |= row > 0
        assert seen.sum() == n and len(rows) >= 1
        assert n == 0 or (rows[-1] > 0).any()


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    model = quality.Cnn.fresh()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rows = rng.integers(1, 256, (5, quality.CHUNK)).astype(np.uint8)
    owner, more, labels = np.array([0, 0, 1, 2, 2]), rng.random((3, 2)), np.array([1, 0, 1])
    _, grads = model.gradient(rows, owner, more, labels)
    for name, w in model.w.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        kept, losses = w[at], []
        for d in (2e-4, -2e-4):
            w[at] = kept + d
            losses.append(model.gradient(rows, owner, more, labels)[0])
        w[at] = kept
        assert (losses[0] - losses[1]) / 4e-4 == pytest.approx(grads[name][at], rel=0.03, abs=1e-4)


def test_held_out_accuracy_and_folds(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.QUERIES["op9_byte_cnn_quality"](spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good = [p for p, q in out if q == 1]
    bad = [p for p, q in out if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_odd_rows(spark):
    rows = [(i, "fine words in a row " * 5, 1) for i in range(30)] + [(i, "### $$$ !!! " * 9, 0) for i in range(30, 60)]
    rows += [(70, None, 1), (71, "", 0), (None, "x", 1), (72, "long " * 30000, None), (72, "long " * 30000, None)]
    docs = spark.createDataFrame([(d, t, "a", 1.0) for d, t, _ in rows], "doc_id long, text string, score string, label double")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows] + [(1, 0, 1)], "doc_id long, quality int, score int")
    found = quality.score(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert quality.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
