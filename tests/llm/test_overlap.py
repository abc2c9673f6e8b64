import itertools

import numpy as np
import pytest

from murmur.llm import overlap, simhash, stages

DDL = "doc_id long, text string, node string, component_id string"


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """Smallest id by all pairs with a Jaccard similarity of 0.8 or more."""
    by = {}
    for d, t in rows:
        by.setdefault(sets(t), []).append(d)
    group = {s: min((d for d in ids if d is not None), default=None) for s, ids in by.items()}
    near = [(a, b) for a, b in itertools.combinations(by, 2) if len(a & b) / len(a | b) >= 0.8]
    moved = True
    while moved:
        moved = False
        for a, b in near:
            low = min((g for g in (group[a], group[b]) if g is not None), default=None)
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                moved = True
    return sorted(((d, group[sets(t)]) for d, t in rows), key=str)


def got(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "n", "c") for d, t in rows], DDL)
    return sorted((tuple(r) for r in overlap.near_copies(docs, **more).collect()), key=str)


@pytest.mark.parametrize("homes", [4096, 3])
def test_groups_match_all_pairs(spark, homes):
    """Chains of edits around the threshold, beside a line that all texts hold."""
    rng = np.random.default_rng(5)
    line = "this line is the same in every one of the texts"
    rows = []
    for _ in range(4):
        base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
        for _ in range(20):
            base = list(base) if rng.random() < 0.5 else base
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 5)):
                words[at] = f"v{rng.integers(0, 5000)}"
            rows.append((len(rows), f"{' '.join(words)} {line}"))
            base = words if rng.random() < 0.3 else base
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one two three"), (None, rows[0][1]), (None, "alone")]
    want = brute(rows)
    assert 8 < len({g for _, g in want}) < 70
    assert got(spark, rows, homes=homes) == want


def test_stage_drops_near_copies_far_apart_in_bits(spark):
    words = [f"w{i}" for i in range(100)]
    near = [*words[:30], "other", *words[31:70], "thing", *words[71:]]
    far = [*words[:50], *(f"x{i}" for i in range(50))]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    assert bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).count("1") > 3
    docs = spark.createDataFrame([(d, t, "n", "c") for d, t in rows], DDL)
    assert {r.doc_id for r in stages.near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_stage_finds_every_pair_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:1]) == [(rows[0][0], rows[0][0])]
    assert overlap.near_copies(spark.createDataFrame([], DDL)).count() == 0


def test_bands_find_pairs_at_the_threshold():
    """Share of pairs of a similarity of just 0.8 with a band in common, and what the fingerprint finds of close ones."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        values = rng.integers(-(2**63), 2**63, 440)
        a, b = np.unique(values[:400]), np.unique(values[40:])
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) > 0.8
        met += bool(set(overlap.bands_of(a)) & set(overlap.bands_of(b)))
    assert met == 300
    found = overlap.shingles([b"w%d" % i for i in range(30_000)])
    assert overlap.bands_of(found) == overlap.bands_of(found[::1].copy()) and len(set(overlap.bands_of(found))) == overlap.BANDS
    assert overlap.fingerprint(found) == overlap.fingerprint(np.sort(found))
