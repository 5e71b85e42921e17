"""A corpus pipeline of five of the operators, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluxora.llm import mixing, packing, quality, secrets, setsketch
from fluxora.llm.common import load, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence reject go."""
    return quality.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return setsketch.first_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secrets.mask_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights: a row per epoch, cut where a leaf's budget ends."""
    return mixing.mixed_docs(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("secret_scans", without_secrets),
    ("mixing", mixed),
    ("packing", packed_sequences),
]

# Stages 1, 2 and 5 (learnt references, sketches, tokenizer) cannot be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
