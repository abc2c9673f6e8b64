import zlib

import numpy as np
import pytest

from murmur.llm import language, queries

DDL = "doc_id long, text string, lang string, score string, held_out string, lang_pred long"


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    model = language.Gru.fresh(["a", "b", "c"], hidden=4)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rows, labels = rng.integers(0, 256, (5, 9)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = model.gradient(rows, labels)
    for name, w in model.w.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        if name[0] == "p":
            at = (rows[0, 3], at[1])
        kept, losses = w[at], []
        for d in (1e-5, -1e-5):
            w[at] = kept + d
            losses.append(model.gradient(rows, labels)[0])
        w[at] = kept
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6)


def test_every_byte_is_pooled_once():
    model = language.Gru.fresh(["a", "b"])
    texts = [language.as_bytes(t) for t in ("x" * 700, "", "Ünï", "y" * 128)]
    alone = np.concatenate([model.probabilities([t]) for t in texts])
    together = model.probabilities(texts)
    assert np.allclose(alone, together, atol=1e-5)
    assert np.allclose(together.sum(axis=1), [1, 0, 1, 1], atol=1e-5)


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op5_bidirectional_gru_language"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    out = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(out) > 0.97


def test_odd_rows(spark):
    text = "the quick brown fox jumps over it "
    rows = [(i, text * (i % 3 + 1), "en") for i in range(40)] + [(i, "la maison est là " * 4, "fr") for i in range(40, 80)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "12 34 !!", "fr"), (None, text, None), (None, text, None), (103, "é" * 30000, None)]
    docs = spark.createDataFrame([(d, t, g, "s", "h", 1) for d, t, g in rows], DDL)
    found = language.identify(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 1 for i in (100, 101, 102))
    assert by[103].lang_pred in ("en", "fr") and not by[None].held_out
    assert language.keep(docs).columns == docs.columns
    assert {r.doc_id for r in language.keep(docs).collect()} == {d for d, *_ in rows} - {100, 101, 102}
    assert language.identify(docs.limit(0)).count() == 0
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.identify(unknown).collect()} == {"und"}


def test_lang_is_no_input_of_a_prediction(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    other = docs.selectExpr("doc_id", "text", "'xx' as lang")
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(other, model).collect()} == plain
