"""The corpus pipeline: raw documents to a mixed, tokenized training set.

Each stage takes ``(spark, docs, sf_dir)`` and returns documents with the columns that came in (the last: what it
wrote). Its input is the whole output of the stage before, read back from Parquet.

Defined cases are those of the operators: a document without letters goes in the first stage (and with it null and
empty texts), repeated rows are one document from the second stage on, a null id stays, an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.shared import keep
from tidemark.llm import decontam, langid, mixing, shingles, tokens


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language, or with none for half of their words, go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup on five-word shingles alike by 0.8 or more: of each group the document with the smallest id stays."""
    return shingles.near_dedup(docs)


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that overlap with an item of the benchmark go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as the systematic sample drew it."""
    return mixing.mixed_documents(docs)


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID records: written in order of id and read back."""
    return tokens.encoded_rows(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_overlap", benchmark_overlap),
    ("mixture", mixture),
    ("records", records),
]

#: SQL can't express the first three stages; tests hold each stage and the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
