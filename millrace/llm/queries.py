"""The queries of the operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, fill_in_middle, html_text, language, licences, mixture, packing, periodic_runs, repetition
from millrace.llm import simhash, tokens, toxicity, warc
from millrace.llm.common import held_out
from millrace.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), where=~held_out("doc_id", 5, 0))
    out = toxicity.tag(docs, model)
    return out.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        F.col("__score").alias("score"),
        F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.col("__spans").alias("spans"),
    )


def op2_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(table(spark, folder, "documents"), weights=(1, 2, 3), most=3.0, preference=mixture.by_length)


def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.find_licences(table(spark, folder, "documents"), licences.known_digests(spark))


def op4_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.quality_rules(table(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), length=3, radius=3)


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs, where=~held_out("doc_id", 4, 2))
    out = language.identify(docs, model)
    return out.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"),
        F.col("__rejected").alias("rejected"),
    )


def op8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_text_tokens(table(spark, folder, "documents"), tokens.load_vocabulary())


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.runs_report(table(spark, folder, "documents"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, folder, "documents"))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixture": op2_mixture,
    "op3_licences": op3_licences,
    "op4_repetition": op4_repetition,
    "op5_simhash": op5_simhash,
    "op6_html_text": op6_html_text,
    "op7_language": op7_language,
    "op8_tokens": op8_tokens,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_packing": op13_packing,
}

SQL: dict[str, str] = {
    "op2_mixture": mixture.SQL,
    "op3_licences": licences.SQL,
    "op10_warc": warc.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
}
