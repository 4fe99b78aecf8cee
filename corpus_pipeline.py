"""From raw documents to a training mix: quality, toxicity, near copies, benchmark passages, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, mixture, repetition, simhash, toxicity
from millrace.session import materialize, prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repetitive and tiny documents go."""
    return repetition.keep_unrepetitive(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, learnt from the given labels of what is left, finds toxic go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: fingerprints of 3-word runs within 3 bits."""
    return simhash.keep_first(docs, length=3, radius=3)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontamination.keep_clean(docs, benchmark)


def mixture_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is mixed to the target weights: the documents of the mix and their number of copies."""
    return mixture.mixed(docs, weights=(1, 2, 3), most=3.0, preference=mixture.by_length)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("simhash", near_copies),
    ("decontamination", decontaminated),
    ("mixture", mixture_of_sources),
]

#: The stages learn models and build a suffix array, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
