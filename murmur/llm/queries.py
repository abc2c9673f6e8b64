"""Registered queries of the text operators, ``opN_<name>``, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from murmur.llm import (
    divergence, hostrules, language, latent, packing, quality, quantised, quotes, resample, secrets, simhash, sitetree,
    surrogates,
)
from murmur.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quotation_linking")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as mails, linked by what they quote, without the quotes."""
    return quotes.conversations(quotes.as_mails(table(spark, sf_dir, "conversations")))


@query("op2_sum_of_squares_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_simhash_anchors")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    return surrogates.replace(table(spark, sf_dir, "documents"))


@query("op5_bidirectional_gru_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    return language.identify(table(spark, sf_dir, "documents"))


@query("op6_host_level_rules", hostrules.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and the verdict with its host's."""
    return hostrules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


@query("op7_latent_semantic_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the evidence."""
    return latent.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_grammar_inference_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op9_byte_cnn_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fold."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_site_style_tree")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return sitetree.extract(table(spark, sf_dir, "pages"))


@query("op11_regular_sampling_resampling", resample.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document, and the rank of those that are drawn."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_product_quantisation", quantised.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector."""
    return quantised.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op13_source_divergence", divergence.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and by which terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))
