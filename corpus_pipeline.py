"""A training corpus from ``documents`` in five stages, each an operator of ``motion_tables.llm``.

Each stage works on all that the one before it kept and returns the columns of documents; the last adds size, source_size,
target and taken, the words that the mix takes of each document (0 if none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motion_tables.llm.decontamination import decontaminated
from motion_tables.llm.jaccard_join import first_of_groups
from motion_tables.llm.line_dedup import deduped
from motion_tables.llm.mixing import mixed
from motion_tables.llm.quality_classifier import accepted
from motion_tables.llm.tables import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more stay."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on six sources or more stand once in the corpus; documents that were nothing else go."""
    return deduped(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays."""
    return first_of_groups(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix of the sources takes of it."""
    return mixed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: SQL cannot express the classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is a stored table of the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
