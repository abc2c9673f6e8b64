import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from murmur.llm import resample

DDL = "doc_id long, text string, rank int, score string, n_words string"


def brute(docs, target, percent=10, least=20, order=1, buckets=10_000):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(f.encode()) % buckets for f in runs]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    rows = []
    for d, text in docs:
        n, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(fit) * percent // 100
    out = [(*r[:4], None) for r in rows if r[4] < least]
    return sorted(out + [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(fit)], key=str)


def frame(spark, docs, parts=1):
    return spark.createDataFrame([(d, t, 1, "s", "n") for d, t in docs], DDL).repartition(parts)


def goal(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize(("percent", "runs", "order"), [(10, 512, 1), (60, 5, 2), (100, 3, 1), (0, 4, 1)])
def test_ranks_as_a_plain_sort_does(spark, percent, runs, order):
    docs = [(i, f"Word{i % 7} und Straße{i % 11} " * (1 + i % 23)) for i in range(300)]
    docs += [(7, docs[7][1])] * 3 + [(None, "a b c " * 9), (None, None), (901, None), (902, ""), (903, "?! --"), (904, "x " * 60_000)]
    target = ["Word3 und mehr", None, "", "Straße5 " * 30]
    got = resample.resample(frame(spark, docs, 6), goal(spark, target), percent=percent, runs=runs, order=order)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, percent, order=order)


def test_ranks_when_all_scores_are_equal(spark):
    """One id and one score for all rows: ranks are still 1, 2, 3 ... and segments of one size."""
    rows = spark.range(2000, numPartitions=8).selectExpr("cast(3 as long) doc_id", "1L n_features", "0L weight", "5L score")
    found = resample.sorted_runs(rows)
    cuts = resample.splitters(found)
    assert len(cuts) == len(set(cuts)) == 8
    places = sorted(r.place for r in found.collect())
    sizes = [sum(a <= (-5, 3, p) < b for p in places) for a, b in zip([(-9,), *cuts], [*cuts, (9,)], strict=True)]
    assert sum(sizes) == 2000 and max(sizes) <= 2 * 250
    ranks = sorted(r["rank"] for r in resample.ranked(rows).collect())
    assert ranks == list(range(1, 2001))


def test_empty_tables(spark):
    docs = [(1, "word " * 30), (2, "other " * 30)]
    none = frame(spark, docs).limit(0)
    assert resample.resample(none, goal(spark, ["a"])).count() == 0
    got = resample.resample(frame(spark, docs), goal(spark, ["a"]).limit(0), percent=50)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, [], 50)
