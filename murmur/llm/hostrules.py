"""Quality rules by host: failures of documents pooled by domain and shrunk.

Every document is measured whole. A document *fails* if the base rule fails, or
it has over one symbol in ten words, or over three in ten of its lines repeat an
earlier one, or its words are shorter than 2 or longer than 12 characters on
average. The failure rate of a host is shrunk towards the corpus with a beta
prior whose mean and strength come from all hosts (method of moments); a host
whose shrunk rate is over ``HOST_LIMIT`` is rejected with all its documents.
A document is kept if the base rule passes and its host is not rejected.

Counts of a host are sums that combine before they are shuffled, so a host with a
third of all rows is no task of its own. Null text has no words. A null host is a
host of its own. Repeated rows count each time. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import batch, small_batches
from murmur.session import materialise

WINDOW = 3
MIN_WORDS = 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
WHITE = " \t\n\r\x0b\x0c"
HOST_LIMIT = 0.5
#: Hosts whose verdicts (some 50 bytes each) are broadcast; beyond, a shuffle join.
BROADCAST_HOSTS = 100_000
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
MEASURES = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), *((f, pa.int64()) for f in FIELDS)]
)


def repeated_words(words: list) -> int:
    """Words that lie in a window of three that occurs twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, until = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + WINDOW - max(until, at)
            until = at + WINDOW
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The fields of ``FIELDS`` for one text."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, "#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measures(docs: DataFrame) -> DataFrame:
    """Measures of every row beside its id and host (column ``source``)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = list(zip(*map(measure, rows.column("text").to_pylist()), strict=True)) or [()] * len(FIELDS)
            yield batch(
                MEASURES,
                {"doc_id": rows.column("doc_id"), "host": rows.column("host")} | dict(zip(FIELDS, map(list, found), strict=True)),
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, ", ".join(["doc_id long", "host string", *(f"{f} long" for f in FIELDS)]))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def failed():
    n = F.col("n_words")
    return (
        base_failed()
        | (10 * F.col("n_symbols") > n)
        | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
        | (F.col("word_chars") > 12 * n)
        | (F.col("word_chars") < 2 * n)
    )


def hosts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and verdict."""
    counts = measured.groupBy("host").agg(
        F.count("*").alias("n"), F.sum(failed().cast("long")).alias("bad")
    )
    # moments of the hosts' rates, less what chance alone adds to their spread
    mean = F.col("all_bad") / F.col("all_n")
    spread = F.coalesce("spread", F.lit(0.0)) - mean * (1 - mean) * F.col("inverse")
    strength = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(STRONGEST)
    prior = counts.agg(
        F.sum("n").alias("all_n"),
        F.sum("bad").alias("all_bad"),
        F.var_samp(F.col("bad") / F.col("n")).alias("spread"),
        F.avg(1 / F.col("n")).alias("inverse"),
    ).select(
        mean.alias("mean"), F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), strength)).alias("strength")
    )
    # the prior is one row
    rate = (F.col("bad") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return (
        counts.withColumn("one", F.lit(1))
        .join(prior.withColumn("one", F.lit(1)), "one")
        .select("host", "n", "bad", rate.alias("rate"), (rate > limit).alias("rejected"))
    )


def judge(docs: DataFrame, limit: float = HOST_LIMIT, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Measures of every row with ``base_failed``, the host's shrunk rate and ``kept``."""
    measured = materialise(measures(docs), "host-measures")
    verdicts = materialise(
        hosts(measured, limit).select("host", F.col("rate").alias("host_rate"), "rejected"), "host-verdicts"
    )
    if verdicts.count() <= broadcast_hosts:
        verdicts = F.broadcast(verdicts)
    return measured.join(verdicts, "host").select(
        "doc_id",
        *FIELDS[:-1],
        base_failed().alias("base_failed"),
        "host_rate",
        (~base_failed() & ~F.col("rejected")).alias("kept"),
    )


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
spots AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3),
windows AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS x FROM spots),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM windows) WHERE c > 1),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, d.host, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
  coalesce(a.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM docs d JOIN words USING (rid) LEFT JOIN again a USING (rid) LEFT JOIN lines l USING (rid)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
g AS (SELECT *, (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars > 12 * n_words OR word_chars < 2 * n_words) AS failed FROM f),
h AS (SELECT host, count(*) AS n, sum(failed::int) AS bad FROM g GROUP BY host),
p AS (SELECT sum(bad) / sum(n) AS mean, coalesce(var_samp(bad / n), 0) AS spread, avg(1.0 / n) AS inverse FROM h),
q AS (SELECT mean, CASE WHEN spread - mean * (1 - mean) * inverse > 0
  THEN greatest(1.0, least(1e6, mean * (1 - mean) / (spread - mean * (1 - mean) * inverse) - 1)) ELSE 1e6 END AS strength FROM p),
v AS (SELECT host, (bad + mean * strength) / (n + strength) > 0.5 AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT rejected) AS kept
FROM g JOIN v USING (host)
"""
