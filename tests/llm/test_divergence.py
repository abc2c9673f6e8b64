import itertools
import re
from collections import Counter

import numpy as np
import pytest

from murmur.llm import divergence

DDL = "doc_id long, text string, lang string, source string, p long, value string, item string"


def brute(docs, least=10, top=10):
    rows = [(lang or "", source or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        held = Counter(t for a, _, w in rows if a == lang for t in w)
        kept = sorted(t for t, n in held.items() if n >= least)
        sources = sorted({s for a, s, _ in rows if a == lang})

        def shares(which):
            n = Counter()
            for a, s, w in rows:
                if a == lang and (which is None or s == which):
                    n.update(w)
            total = sum(n[t] for t in kept)
            return n, {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(None)[1]
        by = {s: shares(s) for s in sources}
        for s in sources:
            n, p = by[s]
            f = lambda a, b: (a - b) ** 2 // (a + b)
            pairs = sorted((-sum(f(p[t], by[o][1][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(p[t], q[t]), t.encode(), t) for t in kept if n[t] and p[t] > q[t])
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, 1, "v", "i") for i, d in enumerate(docs)], DDL)


def corpus(seed, n, sources, words):
    rng = np.random.default_rng(seed)
    return [
        (" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in (rng.zipf(1.4, 40) % words)), ["en", "de"][rng.integers(2)], f"s{rng.integers(sources)}")
        for _ in range(n)
    ]


@pytest.mark.parametrize("held", [500_000, 40])
def test_audit_as_the_plain_sums(spark, monkeypatch, held):
    """Common and rare words over many sources; groups without terms, nulls, ties, repeats, long texts."""
    monkeypatch.setattr(divergence, "HELD", held)
    docs = corpus(1, 300, 12, 120)
    docs += [(None, "en", "empty"), ("", "en", None), ("123 !?", None, "s1"), (None, None, None), ("Lone", "xx", "a"), ("lone", "xx", "b")]
    docs += [docs[0]] * 5 + [("LONG é " * 40_000, "de", "s1")] + [("one two", "tie", f"t{i % 4}") for i in range(40)]
    want = brute(docs)
    assert {r[2] for r in want} == {"pair", "term"}
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, docs)).collect()) == want


def test_nothing(spark):
    assert divergence.audit(frame(spark, [("a", "b", "c")]).limit(0)).count() == 0


def test_a_node_is_counted_once_for_all_rows_below_it():
    """The tree adds up what all pairs of all rows add up, with fewer steps than rows have pairs."""
    rng = np.random.default_rng(2)
    rows = Counter()
    for _ in range(3000):
        rows[tuple((s, int(10 + 5 * rng.integers(3)), 7) for s in "abcdef" if rng.random() < 0.7)] += 1
    paths = sorted(rows)
    offsets = np.cumsum([0, *map(len, paths)])
    columns = list(np.array([(ord(s) - 97, p, z) for path in paths for s, p, z in path]).T)
    times = [rows[path] for path in paths]
    got = Counter()
    for a, b, value in divergence.corrections(offsets, *columns, times):
        for i, j, v in zip(a.tolist(), b.tolist(), value.tolist(), strict=True):
            got[chr(97 + i), chr(97 + j)] += v
    f = divergence._apart
    want = Counter()
    for path, n in rows.items():
        for (a, p, z), (b, q, y) in itertools.combinations(path, 2):
            want[a, b] += n * (f(p, q) - f(p, y) - f(z, q) + f(z, y))
    assert got == want
    entry, below = divergence.nodes_of(offsets, divergence.shared_beginnings(offsets, columns), times)
    beginnings = Counter()
    for path, n in rows.items():
        for i in range(len(path)):
            beginnings[path[: i + 1]] += n
    assert sorted(below.tolist()) == sorted(beginnings.values()) and len(entry) < offsets[-1]
