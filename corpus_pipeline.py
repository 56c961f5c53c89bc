"""From raw documents to packed sequences: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again. The first four return the columns of
``documents``: the quality rules drop rejected documents, of each component of SimHash fingerprints (popcount grid, three bits) one document
stays and of these one of each group of five-word similarity 0.8, contaminated documents go, and personal data is replaced by labels inside the texts. The last stage returns the packed pieces with their token ids;
``packing.sequences`` puts them together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import decontaminate, packing, pii, quality, simhash, similar
from folioforge.operators.lineage import written_once

# The workers of a cluster live on from stage to stage, so the last one keeps fewer token ids than packing alone would.
CACHE_ENTRIES = 60_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of op7's fingerprints, then one of each group of similar texts among these."""
    return similar.representatives(written_once(simhash.representatives(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, with_ids=True, cache_entries=CACHE_ENTRIES)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

# Fingerprint components, bootstrapping and packing are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written_once(docs)
    return docs
