import numpy as np
import pytest

from murmur.llm import quantised

DDL = "vec_id long, embedding array<float>, n int, node string, component string, k1 long"


def brute(rows, cosine=0.95):
    fit = []
    for r, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            fit.append((r, x / np.linalg.norm(x)))
    near = {r: [s for s, y in fit if s != r and len(y) == len(x) and x @ y >= cosine] for r, x in fit}
    out = []
    for r, (d, _) in enumerate(rows):
        seen, todo = {r}, [r]
        while todo:
            for s in near.get(todo.pop(), []):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        low = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((d, len(near.get(r, [])), low, d is not None and d == low))
    return sorted(out, key=str)


def got(spark, rows):
    frame = spark.createDataFrame([(d, v, 1, "x", "y", 3) for d, v in rows], DDL)
    return sorted((tuple(r) for r in quantised.near_duplicates(frame).collect()), key=str)


def vectors(seed, groups, each, width, noise):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.normal(size=width)
        out += [(base + noise * rng.normal(size=width)).tolist() for _ in range(each)]
    return out


@pytest.mark.parametrize(("width", "noise"), [(16, 0.2), (64, 0.18), (3, 0.15)])
def test_links_as_all_pairs_do(spark, width, noise):
    """Groups around the threshold, chains between them, copies, and what links with nothing."""
    rows = list(enumerate(vectors(width, 40, 12, width, noise)))
    rows += [(i + 5000, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[3][1]), (None, rows[60][1])]
    rows += [(900, None), (901, []), (902, [0.0] * width), (903, [float("nan")] * width), (904, [1.0, None, *[0.0] * (width - 2)]), (905, [float("inf")] * width)]
    rows += [(906, rows[5][1][:-1]), (907, rows[5][1][:-1]), (908, [7 * x for x in rows[5][1]])]
    want = brute(rows)
    assert sum(n for _, n, _, _ in want) > 1000
    assert got(spark, rows) == want


def test_a_hot_list_is_split(spark, monkeypatch):
    """One tight group larger than a shard: more shards, same links."""
    monkeypatch.setattr(quantised, "SHARD", 1)
    rows = list(enumerate(vectors(1, 1, 300, 24, 0.1) + vectors(2, 60, 2, 24, 0.1)))
    assert got(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert got(spark, [(4, [1.0, 2.0])]) == [(4, 0, 4, True)]


def test_coded_distance_bounds_and_turns():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = quantised.Quantiser(x, 12, 0.95)
    own, codes, err = model.encode(x)
    decoded = model.coarse[own] + model.decoded(codes)
    assert np.allclose(np.linalg.norm(x - decoded, axis=1), err)
    # every neighbour lies in a list that is probed by one of both, as the reach is 1 here
    assert model.reach == 1.0
    y = x + 0.05 * rng.normal(size=x.shape)
    y /= np.linalg.norm(y, axis=1)[:, None]
    other, _, _ = model.encode(y)
    near = (x * y).sum(axis=1) >= 0.95
    lists = np.arange(12)
    forth = model.probed(x, own, lists)[np.arange(500), other]
    back = model.probed(y, other, lists)[np.arange(500), own]
    assert near.sum() > 100 and (forth | back)[near].all() and (own != other)[near].any()
    a, b = np.meshgrid(lists, lists)
    assert ((quantised.turn(a, b) ^ quantised.turn(b, a)) == (a != b)).all()


def test_recall_on_the_given_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(spark, rows) == brute(rows)
