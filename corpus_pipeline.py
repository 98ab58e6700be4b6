"""A corpus pipeline: each stage takes the documents its predecessor kept and lets its decisions take effect.

Language identification drops documents in no known language, near-duplicate detection keeps
the document of the least id of each group, decontamination drops documents that hold a
benchmark passage, personal data is masked in place, and mixing adds a rate to each document
and drops those with rate 0. All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialspan.llm import _store, decontaminate, language, mixing, neardup, pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known(docs, language.train(docs.where(~language.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.weighted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_masking", pii_masking),
    ("source_mixing", source_mixing),
]

#: Code lengths under frozen statistics, alignments and fitted rates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written as Parquet and read again. Once it stands, all tables that it was made of go, the one before it included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = _store.standing()
    for name, stage in STAGES:
        docs = _store.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        _store.swept(before, docs)
    return docs
