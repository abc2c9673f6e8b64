"""Registration of queries and small SQL builders for the oracle side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what DuckDB runs on the same tables."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(column: Column | str) -> Column:
    """An instant as a zone-less timestamp in UTC, the form the driver compares."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")


def uuid5_sql(namespace: str, name: str) -> str:
    """The same identifier in DuckDB."""
    seed = namespace.replace("-", "")
    return (
        "(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||"
        "translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr(h,18,3)||'-'||"
        f"substr(h,21,12) FROM (SELECT sha1(unhex('{seed}')||encode({name})) AS h))"
    )


def prefixed_sql(*fields: str) -> str:
    """Length-prefixed bytes of the given text expressions."""
    return "||".join(
        f"unhex(printf('%016x', octet_length(encode({f}))))||encode({f})" for f in fields
    )
