"""The queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.language_id import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.secret_scan import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.passages import documents_with_repeats

    return documents_with_repeats(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.language_model import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.html_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.packing import best_fit_packing

    return best_fit_packing(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.quality_rules import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.set_join import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cortexlake.llm.hard_negatives import hard_negatives

    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_id, op2_minhash_near_dup, op3_secret_scan, op4_substring_dedup, op5_lm_scoring, op6_license_scan, op7_html_extraction, op8_best_fit_packing, op9_quality_rules, op10_decontamination, op11_jaccard_join, op12_merkle_manifest, op13_hard_negatives, pipeline)}
