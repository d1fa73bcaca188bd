"""The training-data pipeline: each stage works on what the one before it kept.

All but the last stage return the columns of their documents, extra ones too, and an empty table for an empty one. Texts are worked on
whole, whatever their length; rows are judged one by one, so that nulls in other columns and ids that repeat or are null do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cortexlake.llm.decontamination import decontaminate
from cortexlake.llm.near_dup import one_of_each
from cortexlake.llm.packing import best_fit_packing
from cortexlake.llm.quality_rules import drop_rejected
from cortexlake.llm.scratch import written
from cortexlake.llm.secret_scan import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; a null or empty text has no words and goes too. Repeated rows share their verdict."""
    return drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; of repeated rows one. A null or empty text has no duplicate."""
    return one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, repeated rows together. A null or empty text has none, nor has an empty benchmark any."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, and a null text stays null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; one row per piece. A null text counts as empty, and repeated rows are packed one by one."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: Near-duplicate components and best-fit packing of tokens aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
