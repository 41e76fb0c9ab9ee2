"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelens.llm.common import labelled
from sitelens.llm import (
    divergence,
    entropy,
    gam,
    jaccard,
    lines,
    mixing,
    neighbours,
    randomness,
    resampling,
    simhash,
    spelling,
    templates,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_rules(_table(spark, sf_dir, "documents"))


def op4_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomness.secrets(_table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.apply_bitmaps(documents, lines.keep_bitmaps(documents))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op7_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = neighbours.toxicity(documents, _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted", "evidence")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = labelled(_table(spark, sf_dir, "labels"), "quality").filter("y = 1")
    return entropy.score(_table(spark, sf_dir, "documents"), good)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))
    return warc.deduplicated(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(spelling.vocabulary(_table(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_gam_quality": op1_gam_quality,
    "op2_template_decontamination": op2_template_decontamination,
    "op3_distribution_divergence": op3_distribution_divergence,
    "op4_random_secrets": op4_random_secrets,
    "op5_source_mix": op5_source_mix,
    "op6_line_dedup": op6_line_dedup,
    "op7_nearest_toxicity": op7_nearest_toxicity,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_cross_entropy_difference": op9_cross_entropy_difference,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_simhash_variants": op13_simhash_variants,
}
