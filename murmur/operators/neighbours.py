"""Ordered sequences per key: the row before without one task per key, and whole sequences to a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def with_previous(
    rows: DataFrame, keys: list[str], index: str, columns: list[str], block: int = BLOCK
) -> DataFrame:
    """Add ``previous``: a struct of ``columns`` of the preceding row, null for the first.

    The sequence is cut into blocks of the index. ``lag`` runs per block; only the last row of
    each block travels on, and those few are lagged per key. Equal indexes are ordered by the
    columns, so the result does not depend on the run.
    """
    carried = F.struct(*columns)
    order = [F.col(index), *[F.col(c) for c in columns]]
    blocked = rows.withColumn("_block", F.floor(F.col(index) / block))
    inside = F.lag(carried).over(Window.partitionBy(*keys, "_block").orderBy(*order))
    ends = blocked.groupBy(*keys, "_block").agg(
        F.max_by(carried, F.struct(index, *columns)).alias("_end")
    )
    before = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.select(*keys, "_block", F.lag("_end").over(before).alias("_end"))
    return (
        blocked.withColumn("_inside", inside)
        .join(ends, [*keys, "_block"], "left")
        .withColumn("previous", F.coalesce("_inside", "_end"))
        .drop("_block", "_inside", "_end")
    )


def in_sequence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of equal keys in one partition, sorted by keys and ``order``, for a fold over partitions.

    ``mapInPandas`` asks for no distribution. A ``repartition`` by the very columns of a join
    below is therefore dropped, and a join that turns into a broadcast or is split for skew
    while running then deals the rows of a key to several tasks. A hash of the keys is no
    column of any join, so this exchange always stays.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
