"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a table.

All but the last return the columns of ``docs`` as they came, whatever else they
hold; only ``text`` and ``n_chars`` are changed, where the text is. Language,
decontamination and secrets decide row by row and shuffle nothing. Near
duplicates are picked by ``doc_id``: rows that share an id share their fate, and
a null id is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import language as lang
from murmur.llm import latent, overlap
from murmur.llm import packing as pack
from murmur.llm import secrets as scan
from murmur.session import prepare


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in the one column of ``ids``."""
    name = ids.columns[0]
    bad = ids.where(F.col(name).isNotNull()).select(F.col(name).alias("__rejected")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["__rejected"], "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without text, or without a likely language go."""
    prepare(spark)
    return lang.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    prepare(spark)
    groups = overlap.near_copies(docs)
    return without(docs, groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    prepare(spark)
    return latent.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked."""
    prepare(spark)
    return scan.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in windows of 2048 tokens."""
    prepare(spark)
    return pack.pack(docs)
