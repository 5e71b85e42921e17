"""The registered queries of the operators, and their DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluxora.llm import mixing, negatives, packing, pages, quality, repair, resampling, secrets
from fluxora.llm import setsketch, simhash, topk, toxicity, warc
from fluxora.llm.common import load


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), k=20, every=20)


def op2_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_shards(repair.write_shards(load(spark, sf_dir, "documents")))


def op3_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(load(spark, sf_dir, "documents"))


def op4_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"))


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(load(spark, sf_dir, "pages"))


def op6_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(
        load(spark, sf_dir, "documents"), setsketch.Sketching(shingle=4, percent=80)
    )


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(load(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(load(spark, sf_dir, "documents"))


def op9_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(load(spark, sf_dir, "documents"))


def op11_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(load(spark, sf_dir, "embeddings"))


def op12_bracketed_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_bktree_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_topk,
        op2_repair_tokens,
        op3_hierarchical_mix,
        op4_divergence_quality,
        op5_page_differencing,
        op6_setsketch_near_duplicates,
        op7_warc_salvage,
        op8_best_fit_packing,
        op9_convolutional_toxicity,
        op10_randomness_secrets,
        op11_angular_negatives,
        op12_bracketed_resampling,
        op13_bktree_simhash,
    )
}

ORACLES: dict[str, str] = {
    "op1_exact_topk": topk.ORACLE,
    "op3_hierarchical_mix": mixing.oracle(),
    "op7_warc_salvage": warc.ORACLE,
    "op11_angular_negatives": negatives.ORACLE,
    "op12_bracketed_resampling": resampling.oracle(),
}
