import numpy as np
import pytest

from murmur.llm import queries, simhash

DDL = "doc_id long, text string, fingerprint string, fp string, node string, component_id string"


def brute(texts):
    prints = [simhash.fingerprint(t) for _, t in texts]
    low = list(range(len(texts)))
    changed = True
    ids = [d for d, _ in texts]
    group = list(ids)
    near = [
        [j for j in range(len(texts)) if bin(prints[i] ^ prints[j]).count("1") <= 3]
        for i in range(len(texts))
    ]
    while changed:
        changed = False
        for i in low:
            known = [group[j] for j in near[i] if group[j] is not None]
            if known and group[i] != min(known):
                group[i], changed = min(known), True
    return sorted(
        ((d, format(p, "016x"), g) for d, p, g in zip(ids, prints, group, strict=True)), key=str
    )


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "one"), (4, "One"), (5, "a b c d e"), (5, "a b c d e"),
             (None, "a b c d e"), (None, "never seen elsewhere at all"), (7, " ".join(map(str, range(40000))))]
    docs = spark.createDataFrame([(d, t, "x", "y", "z", "q") for d, t in texts], DDL)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(texts)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_agrees_with_all_pairs(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op3_simhash_anchors"](spark, sf).collect()), key=str)
    assert got == brute(texts)


@pytest.mark.parametrize("homes", [4096, 3])
def test_links_connect_like_all_pairs(spark, homes):
    """Clusters of near prints, with small blocks as for a hot anchor."""
    rng = np.random.default_rng(3)
    prints = set()
    for centre in rng.integers(0, 2**63, 12).tolist():
        for _ in range(25):
            p = centre
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                p ^= 1 << bit
            prints.add(p)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, node long")
    edges = [(r.a, r.b) for r in simhash.links(frame, homes_limit=homes).collect()]

    def groups(pairs):
        low = list(range(len(prints)))
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                if low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
        return low

    pairs = [(i, j) for i in range(len(prints)) for j in range(i)
             if bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 3 for a, b in edges)
    assert groups(edges) == groups(pairs)


def test_fingerprint_bits():
    import xxhash

    words = "The quick brown FOX jumps the quick brown fox".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))
    assert simhash.fingerprint("The quick brown FOX jumps\nthe\tquick  brown fox") == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
