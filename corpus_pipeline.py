"""A training corpus in five stages, each a table written in full before the next reads it.

Language ID rejects what is in none of the learned languages; of each group of near copies one document stays; benchmark passages
are cut out, and documents that are mostly benchmark go; personal data is replaced; the mix takes each source's documents as often as its
target asks, a row per copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontaminate, langid, mixing, neardup, pii
from loomline.llm.scratch import pin, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(langid.learnable(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies(mixing.mix(docs, carry=docs.columns))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
]

#: No SQL can express the first two stages and the fourth; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = made = pin(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)  # the next stages read what this one has written
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
