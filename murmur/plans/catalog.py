"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmur.operators import burst
from murmur.plans import detection, extraction, governance, reads, sample, sealed, sinks, streams
from murmur.plans.registry import ORACLES, QUERIES
from murmur.session import prepare

__all__ = [
    "ORACLES", "QUERIES", "detection", "extraction", "flagship", "governance", "reads", "sealed", "sinks",
    "streams",
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [burst.BurstRule("hour", "hour windows", 3600, 4, 3)]
    return burst.detect(sample.observations(prepare(spark), sf_dir), rules)
