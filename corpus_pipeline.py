"""The corpus pipeline: five stages of the training-data operators, each over all its predecessor kept.

Every stage takes and returns the columns of ``documents``, but for the last, whose rows are the
documents' sampled segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import decontaminate, langid, near_copies, pieces, pii
from noticelake.storage import cut, drop


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or in none of the languages go; the predicted language is set."""
    found = langid.identify(docs, out="__language")
    return found.where(~F.col("__language.rejected")).withColumn("lang", F.col("__language.lang")).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return near_copies.keep_one(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.with_matches(docs, benchmark, out="__matches")
    return found.where(F.size("__matches") == 0).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; the number of characters follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's sampled segmentations with their scores."""
    return pieces.with_samples(docs).select("doc_id", "lang", "source", "n_chars", "samples")


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", deduplicate),
    ("decontamination", remove_benchmarks),
    ("pii", mask_personal_data),
    ("sentencepiece", segment),
]

#: SQL has neither the language models nor XXH64 nor the sampler; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        drop(*stored)  # nothing reads a stage's table once the next one's is written
        stored = [docs]
    return docs
