"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import chat, decontaminate, fim, packing, periods, pii, quality, ranker, rlz, simhash, tokenfile, toxicity, warc
from folioforge.llm.common import table
from folioforge.operators.lineage import fresh_path


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path)
    return tokenfile.read(spark, path)


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts look like control strings."""
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.examples(conversations))


def op7_popcount_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(table(spark, sf_dir, "documents"))


def op6_folded_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.scores(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op3_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.deduplicated(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_counted_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.examples(table(spark, sf_dir, "documents")))


def op12_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranker.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_seeded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.detect(periods.planted(table(spark, sf_dir, "documents"))))
