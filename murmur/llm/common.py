"""Shared pieces of the text operators: inputs, Arrow batches, components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import materialise

#: Documents that travel to a Python worker in one Arrow batch, and their bytes.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that other columns can bear any name."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def in_fold(column: Column | str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part`` modulo ``parts``; null ids are in none."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts == part, F.lit(False))


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def distinct_pairs(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node that has an edge.

    ``edges`` has columns ``a`` and ``b``. Returns ``node`` and ``component``.
    Large-star and small-star steps alternate; each round is written to the
    shared folder, so lineage stays short and a lost executor costs one round.
    Minima are plain aggregates and combine before they are shuffled, so a node
    with very many neighbours is not one task's work. Raises if the graph has
    not settled after ``rounds`` rounds, which takes a path of about 2**rounds.
    """
    edges = materialise(distinct_pairs(edges), f"{name}-edges")
    last = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = materialise(distinct_pairs(large), f"{name}-large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lowest.select("a", F.col("m").alias("b")))
        )
        edges = materialise(distinct_pairs(small), f"{name}-small")
        # a star forest is stable: as many edges as nodes that have a smaller neighbour,
        # and the same sums twice in a row
        mark = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
