import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import packing, queries

DDL = "doc_id long, text string, sequence_id string, start long, `offset` string"


def check(rows, texts, window=packing.WINDOW):
    """Every id once, gapless windows, lengths full or a power of two."""
    encode = packing.encoder()
    want = [(d, np.append(encode(t or ""), packing.SEPARATOR).astype("<u4")) for d, t in texts]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or at & (at - 1) == 0 and at < window
    for doc_id, ids in want:
        copies = sum(d == doc_id for d, _ in want)
        pieces = sorted(by_doc[doc_id], key=lambda p: p["start"])
        assert sum(p["length"] for p in pieces) == copies * len(ids)
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids)


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (4, "a b"), (4, "a b"), (None, "x")]
    docs = spark.createDataFrame([(d, t, "s", 1, "o") for d, t in texts], DDL)
    check(packing.pack(docs).collect(), texts)
    assert packing.pack(docs.limit(0)).count() == 0


def test_many_open_windows_stay_bounded(spark):
    texts = [(i, "word " * (1100 + i % 7)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    check(packing.pack(docs, max_open=8).collect(), texts)


def test_level_minimises_squares():
    rng = np.random.default_rng(5)
    packer = packing.Packer(0, window=64)
    for doc, size in enumerate(rng.integers(1, 64, 500)):
        counts = packer.counts.copy()
        level = packer.level_for(int(size))
        best = {}
        for h in range(0, 64 - size + 1):
            if h and not counts[h]:
                continue
            after = counts.copy()
            if h:
                after[h] -= 1
            if h + size < 64:
                after[h + size] += 1
            best[h] = int((after**2).sum())
        assert best[level] == min(best.values())
        packer.place(doc, np.zeros(size, dtype="<u4"))


@pytest.mark.parametrize(
    "text",
    ["a  b", "a   b", "\n x y\n", " lead ", "don't 'tis", "<|endoftext|> x", "x \n y", "é ü 12.3 %%",
     "a\n\nb", "\n", "end.\nStart, foo!! bar!", "a\n", " ", "x\t y\xa0z", "日本 語.", "x" * 5000],
)
def test_ids_are_the_tokenizer_files(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert plain.encode(text, add_special_tokens=False).ids == packing.encoder()(text).tolist()


def test_query_packs_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.QUERIES["op2_sum_of_squares_packing"](spark, sf)
    check(rows.collect(), [tuple(r) for r in docs])
    padded = rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n < 2048").count()
    assert padded <= 11 * rows.select(F.floor(F.col("sequence_id") / (1 << 36))).distinct().count()
