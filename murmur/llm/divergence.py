"""How far the sources of a language differ in their words: a frequent-pattern tree of term rows.

Terms are runs of letters and characters beyond ASCII, A-Z lower-cased. A language keeps
the terms that ``LEAST`` of its documents hold. The share p of a kept term in a group
(language, source), in billionths and smoothed by two, depends on the group and on how
often the term occurs there; with no occurrence it is the group's constant z. Two
groups' distance is the sum of floor((p-q)^2 / (p+q)) over all kept terms.

Most terms are missing from most sources, so that sum is taken as if all terms were
missing, and corrected:

* all V terms missing from both: V f(z, z');
* terms that occur in one group: m (f(p, z') - f(z, z')) for each share p that m terms
  have there, against every other group of the language;
* terms that occur in both: f(p, p') - f(p, z') - f(z, p') + f(z, z').

The last is found by the tree. A term's row lists the sources in which it occurs, in
order, each with its p and z; equal rows are merged with their multiplicity. In sorted
order rows with a common beginning follow each other, so a task builds the tree by a
depth-first walk over its range of the rows, ``HELD`` entries at a time. Each node gives
its correction with each of its ancestors once, times the terms below it.
Rows are dealt by range of the whole row, so a beginning that a third of the rows share
is cut where it has to be; corrections add up, whatever the cut.

Everything is exact: shares by whole-number division of decimals, the rest in longs.
Nothing but a term's row is gathered, and it has one entry for each source of the
language. The result has one row for each ordered pair of sources of a language.

Null text, lang and source are ''. A group without terms has count 0 for every kept
term; without kept terms all distances are 0. Ties are ordered by the item's bytes.
Repeated rows count again. Very long texts are counted whole, one at a time. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import batch, small_batches
from murmur.session import materialise

LEAST = 10
TOP = 10
SCALE = 1_000_000_000
#: Counts, or entries of rows, that a task holds before it passes them on.
HELD = 500_000
#: Pairs of a node and an ancestor that are worked out at a time.
PAIRS = 1_000_000

WORD = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
SHARED = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def terms_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, by group."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # both counters of a group see new terms in the same order
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                columns = {"lang": pa.repeat(lang, len(n)), "source": pa.repeat(source, len(n))}
                columns["term"] = pa.array(list(n), pa.binary()).cast(pa.string())
                yield batch(COUNTED, columns | {"n": list(n.values()), "docs": list(in_docs.values())})
            held.clear()

        for part in batches:
            keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True)
            for lang, source, text in keys:
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                found = terms_of(text.as_py())
                n.update(found)
                in_docs.update(dict.fromkeys(found).keys())
                size += len(n) - before
                if size > HELD:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    return (
        rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)) without a rounding; 1 where nothing is kept."""
    whole = F.call_function(
        "div",
        F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"),
        (total + 2 * kept).cast("decimal(20,0)"),
    )
    return F.coalesce(F.when(kept > 0, whole + 1), F.lit(1)).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p-q)^2 / (p+q)); both are at most SCALE + 1, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def shared_beginnings(offsets: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """How many leading entries each row has in common with the row before it."""
    sizes = np.diff(offsets)
    n = np.minimum(sizes[1:], sizes[:-1])
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    here, before = np.repeat(offsets[1:-1], n) + at, np.repeat(offsets[:-2], n) + at
    differs = np.zeros(len(at), dtype=bool)
    for c in columns:
        differs |= c[here] != c[before]
    row = np.repeat(np.arange(len(n)), n)[differs]
    first, where = np.unique(row, return_index=True)
    out = n.copy()
    out[first] = at[differs][where]
    return np.concatenate([[0], out])


def nodes_of(offsets: np.ndarray, shared: np.ndarray, times: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The tree of sorted rows: each node's entry in its first row, and the terms in its subtree."""
    path: list[tuple[int, int]] = []
    entry, below, total = [], [], 0
    for start, end, depth, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), shared.tolist(), times, strict=True):
        while len(path) > depth:
            at, before = path.pop()
            entry.append(at)
            below.append(total - before)
        path += [(at, total) for at in range(start + depth, end)]
        total += n
    entry += [at for at, _ in path]
    below += [total - before for _, before in path]
    return np.array(entry, dtype=np.int64), np.array(below, dtype=np.int64)


def corrections(offsets: np.ndarray, source: np.ndarray, p: np.ndarray, z: np.ndarray, times: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, value) of the sorted rows: every node once with each of its ancestors."""
    entry, below = nodes_of(offsets, shared_beginnings(offsets, [source, p, z]), times)
    start = offsets[np.searchsorted(offsets, entry, "right") - 1]
    depth = entry - start
    width = int(source.max(initial=0)) + 1
    cuts = np.searchsorted(np.cumsum(depth), np.arange(1, depth.sum() // PAIRS + 1) * PAIRS)
    for some in np.split(np.arange(len(entry)), np.unique(cuts)):
        d = depth[some]
        own = np.repeat(entry[some], d)
        above = np.repeat(start[some] - np.cumsum(d) + d, d) + np.arange(d.sum())
        if not len(own):
            continue
        value = _apart(p[own], p[above]) - _apart(p[own], z[above]) - _apart(z[own], p[above]) + _apart(z[own], z[above])
        value *= np.repeat(below[some], d)
        key = source[above] * width + source[own]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield key[first] // width, key[first] % width, np.add.reduceat(value[order], first)


def shared_terms(counts: DataFrame) -> DataFrame:
    """(lang, a, b, value): corrections for the terms that occur in both sources, each pair in one order."""
    rows = counts.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "z"))).alias("path"))
    merged = rows.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("times"))
    # equal rows are one row here, so no value of the range key repeats; the range samples its input
    dealt = materialise(merged, "divergence-rows").repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def trees() -> Iterator[pa.RecordBatch]:
            every = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            langs = every.column("lang").to_pylist()
            cuts = [i for i in range(1, len(langs)) if langs[i] != langs[i - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(langs)], strict=True):
                paths = every.column("path").slice(lo, hi - lo).combine_chunks()
                entries = paths.flatten()
                names = entries.field("source").dictionary_encode()
                where = names.indices.to_numpy().astype(np.int64)
                offsets = paths.offsets.to_numpy().astype(np.int64)
                p, z = (entries.field(c).to_numpy() for c in ("p", "z"))
                times = every.column("times").slice(lo, hi - lo).to_pylist()
                for a, b, value in corrections(offsets - offsets[0], where, p, z, times):
                    yield batch(SHARED, {
                        "lang": pa.repeat(langs[lo], len(a)), "a": names.dictionary.take(pa.array(a)),
                        "b": names.dictionary.take(pa.array(b)), "value": value,
                    })

        size = 0
        for part in batches:
            held.append(part)
            size += len(part.column("path").flatten())
            if size > HELD:
                yield from trees()
                size = 0
        if held:
            yield from trees()

    return dealt.mapInArrow(run, "lang string, a string, b string, value long")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``; see the module."""
    # one shuffle by term says which are kept and how often the language has them
    by_term = Window.partitionBy("lang", "term")
    kept = materialise(
        term_counts(docs)
        .withColumn("lang_n", F.sum("n").over(by_term))
        .withColumn("lang_docs", F.sum("docs").over(by_term))
        .withColumn("first", F.min("source").over(by_term) == F.col("source"))
        .where(F.col("lang_docs") >= least)
        .select("lang", "source", "term", "n", "lang_n", "first"),
        "divergence-kept",
    )
    by_lang = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = materialise(
        names.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(by_lang, "lang", "left")
        .select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"),
            F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        )
        .withColumn("z", share(F.lit(0), F.col("total"), F.col("v"))),
        "divergence-groups",
    )
    counts = materialise(
        kept.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "z",
            share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
        ),
        "divergence-shares",
    )

    others = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    missing = groups.join(others, "lang").where("source <> item").select(
        "lang", "source", "item", (F.col("v") * apart(F.col("z"), F.col("y"))).alias("value")
    )
    shares = counts.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("times"))
    single = shares.join(others, "lang").where("source <> item").select(
        "lang", "source", "item",
        (F.col("times") * (apart(F.col("p"), F.col("y")) - apart(F.col("z"), F.col("y")))).alias("value"),
    ).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    shared = shared_terms(counts.select("lang", "source", "term", "p", "z")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one_way = single.union(shared)
    pairs = (
        missing.union(one_way)
        .union(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("part", F.lit("pair"))
    )
    over = counts.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("rank", rank).select(*columns)
        .union(over.withColumn("rank", rank).where(F.col("rank") <= top).select(*columns))
    )


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), used AS (SELECT r, lang, source, unnest(w) AS term FROM words),
kept AS (SELECT lang, term, count(*) AS n FROM used GROUP BY ALL HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM words),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n,
    (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source))::HUGEINT AS total
  FROM groups g JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM used GROUP BY ALL) c
    ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (c.total + 2 * v) AS p,
    1 + 1000000000::HUGEINT * (lang_n + 2) // (v.total + 2 * v) AS q
  FROM counts c JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT FROM terms
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
