import re
from collections import Counter

import duckdb
import pytest

from murmur.llm import hostrules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines))


TEXTS = [None, "", " \n\t", "a b c a b c x", "a a a a", "a a a", "x#y *$ %&|<>", "l\nl\n\nl \nm", "é \x1c ü\x0b z\xa0q", "w " * 20000]


def test_measures_match_brute_force(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text in texts:
        assert hostrules.measure(text) == brute(text)


def docs_of(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, "fine", "x", 1) for i in range(60)]
    rows += [(100 + i, "short text", "bad", "x", 1) for i in range(40)] + [(200, good, "bad", "x", 1)]
    rows += [(300 + i, t, None, "x", 1) for i, t in enumerate(TEXTS)] + [(None, good, "lone", "x", 1), (1, good, "fine", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, host string, n_words int")


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_bad_host_takes_its_documents(spark, broadcast):
    rows = hostrules.judge(docs_of(spark), broadcast_hosts=broadcast).collect()
    assert len(rows) == docs_of(spark).count()
    by = {r.doc_id: r for r in rows}
    assert by[5].kept and not by[100].kept
    assert not by[200].kept and not by[200].base_failed
    # a host with one document is shrunk to the corpus
    assert by[None].kept and by[None].host_rate > 0
    assert hostrules.judge(docs_of(spark).limit(0)).count() == 0


def test_sql_agrees(spark):
    docs = docs_of(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(hostrules.ORACLE).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r) for r in hostrules.judge(docs).select(*names).collect()]
    clean = lambda rows: sorted([tuple(None if x != x else x for x in r) for r in rows], key=str)
    assert [tuple(map(str, r)) for r in clean(got)] == [tuple(str(int(x) if isinstance(x, float) else x) for x in r) for r in clean(want)]
