import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import latent, queries


def whole(text):
    return b" " + b" ".join(latent.words_of(text)) + b" "


def test_query_finds_every_planted_item_and_no_other(spark):
    d = "/root/testdata/sf0.1"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(i, k) for i, t in docs for text in [whole(t)] for k, x in items if whole(x) in text}
    rows = queries.QUERIES["op7_latent_semantic_decontamination"](spark, d).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 100


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(40, 12)) @ rng.normal(size=(12, 30))
    rows = [(list(range(30)), r.tolist()) for r in dense]
    frame = spark.createDataFrame(rows, "ids array<int>, weights array<double>").repartition(5)
    right = latent.randomised_svd(frame, 30, 40, rank=12)
    assert right.shape == (30, 12) and np.allclose(right.T @ right, np.eye(12), atol=1e-8)
    assert np.allclose(dense @ right @ right.T, dense, atol=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_common_subsequence(seed):
    rng = np.random.default_rng(seed)
    a, b = (list(rng.integers(0, 6, n)) for n in (12, 30))

    def brute(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if u == v else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    length, first, last = latent.common_subsequence(a, b)
    assert length == brute(a, b) == brute(a, b[first:last])


ITEM = "Which ancient harbour city lost its lighthouse during the great northern earthquake? The answer is Karvelos."
OTHER = "Explain briefly why copper statues turn green after decades outside in humid weather near oceans."


def corpus(spark):
    rng = np.random.default_rng(8)
    plain = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(plain, n))
    para = ITEM.replace("ancient ", "very old and ancient ").replace("during the great", "in the great").replace("lost its", "lost its tall")
    rows = [(i, text(200)) for i in range(60)]
    rows += [
        (100, f"{text(90)} {ITEM.upper()} {text(70)}"), (101, f"{text(30)} {para} {text(30)}"), (102, None), (103, ""),
        (104, f"{text(40)} which city lost its answer during the {text(20)}"), (None, ITEM), (105, ITEM), (105, ITEM),
        (106, text(30000) + " " + OTHER), (107, ITEM + " " + OTHER), (108, "the short one"), (109, "the very short one"),
    ]
    docs = spark.createDataFrame([(d, t, 1, "w", 0.5) for d, t in rows], "doc_id long, text string, item_id int, word string, cosine double")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "The short one."), (None, OTHER)], "item_id long, text string")
    return docs, items


@pytest.mark.parametrize("block", [latent.BLOCK_CHARS, 150])
def test_paraphrases_and_odd_rows(spark, block):
    docs, items = corpus(spark)
    # a small corpus has no common terms
    found = latent.search(docs, items, block_chars=block).collect()
    got = sorted(((r.doc_id, r.item_id) for r in found), key=str)
    want = [(100, 1), (101, 1), (None, 1), (105, 1), (105, 1), (106, 2), (106, None), (107, 1), (107, 2), (107, None), (108, 5)]
    assert got == sorted(want, key=str)
    left = latent.clean(docs, items, block_chars=block)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {*range(60), 102, 103, 104, 109}


@pytest.mark.parametrize("share", [3, 1])
def test_item_copied_into_many_rows_is_still_found_reworded(spark, share):
    """A hot group makes every word of the item common; its paraphrases must still be found."""
    rng = np.random.default_rng(11)
    plain = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(plain, n))
    words = ITEM.split()
    rows = [(i, f"{text(40)} {ITEM if i % share == 0 else ''} {text(30)}") for i in range(300)]
    for i in range(20):
        new = list(words)
        new[int(rng.integers(0, len(words) - 4))] = f"z{i}"
        new.insert(int(rng.integers(2, 8)), f"y{i}")
        rows.append((1000 + i, f"{text(50)} {' '.join(new)} {text(50)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string")
    got = {r.doc_id for r in latent.search(docs, items).collect() if r.item_id == 1}
    assert got == {i for i in range(300) if i % share == 0} | set(range(1000, 1020))


def test_empty_tables(spark):
    docs, items = corpus(spark)
    assert latent.search(docs.limit(0), items).count() == 0
    assert latent.search(docs, items.limit(0)).count() == 0
    assert latent.clean(docs, items.where(F.lit(False))).count() == docs.count()


def test_cut_space_finds_what_the_whole_one_finds(spark):
    """Fewer directions than passages; reworded items are found as at full rank."""
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    passages = [p for block in latent.blocks_of(items) for p in block]
    cut, whole_space = latent.build(docs, passages), latent.build(docs, passages, energy=1.0)
    ranks = [s.vectors.shape for s in cut.spaces]
    assert sum(n for n, _ in ranks) == len(passages) == sum(len(set(s.which)) for s in cut.spaces)
    assert ranks[0][1] < ranks[0][0] and whole_space.spaces[0].vectors.shape == (len(passages),) * 2
    rng = np.random.default_rng(3)
    found = {}
    for share in (0.1, 0.2, 0.3):
        for r in items.collect():
            words = r.text.split()
            for i in rng.choice(len(words), int(share * len(words)), replace=False):
                words[i] = f"zz{i}"
            text = " ".join([*["qq"] * 50, *words, *["rr"] * 70])
            for name, index in (("cut", cut), ("whole", whole_space)):
                found.setdefault((name, share), set()).update(
                    {r.item_id} & {h[0] for h in latent.search_text(index, text)}
                )
    for share in (0.1, 0.2, 0.3):
        assert found["cut", share] == found["whole", share]
    assert len(found["cut", 0.1]) == items.count()


def test_unlike_passages_beyond_the_rank_take_more_spaces(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(30)], "item_id long, text string")
    docs = items.withColumnRenamed("item_id", "doc_id")
    found = latent.search(docs, items, rank=5).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(30)}


def test_windows_are_bounded_by_group_and_no_candidate_is_lost(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 20 = 0")
    [passages] = latent.blocks_of(spark.read.parquet(f"{d}/benchmark.parquet"))
    index = latent.build(docs, passages)
    [space] = index.spaces
    assert space.most.shape == (len(index.number) + 1, latent.GROUPS)
    reach, seen, bounded, single = latent.WINDOW, 0, 0, 0
    for row in docs.limit(150).collect():
        words = latent.words_of(row.text)
        if not words:
            continue
        ids = np.array([index.number.get(w, -1) for w in words], dtype=np.int32)
        want = set()
        for begin in range(-(reach // latent.STRIDE) + 1, -(-len(ids) // latent.STRIDE)):
            part = ids[max(0, begin * latent.STRIDE) : begin * latent.STRIDE + reach]
            part = part[part >= 0]
            single += np.maximum(space.most[part].max(axis=1), 0).sum() >= latent.COVER
            bounded += (space.most[part].sum(axis=0) >= latent.COVER).any()
            folded = space.fold[part].sum(axis=0, dtype=np.float64)
            weight, norm = space.vectors @ folded, np.linalg.norm(folded)
            sure = (weight >= latent.COSINE * norm + 1e-4) & (weight >= latent.COVER * space.norms + 1e-4) & (norm > 1e-4)
            want |= {(int(p), begin * latent.STRIDE) for p in space.which[sure]}
        got = {c[:2] for c in latent.candidates(space, ids)}
        assert want <= got
        seen += len(want)
    assert seen > 100 and 2 * bounded < single
