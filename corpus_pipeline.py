"""The corpus pipeline: documents through five stages, each one written as Parquet and read again by the next.

Stages keep the columns of documents; the last one returns documents with how often the mix takes them. A stage learns
from what it is given: language models from the documents that reach the first stage, toxicity from those that the
first stage leaves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import common, decontam, langid, minhash, mixing, toxicity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that calibration rejects go."""
    return langid.with_known_language(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.without_toxic(docs, common.load(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return minhash.deduplicated(docs)


def untainted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminated(docs, common.load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, and the words taken (repeats counted)."""
    return mixing.taken_rows(docs)


STAGES = [("language", language), ("toxicity", clean), ("near-dedup", unique), ("decontamination", untainted), ("mixing", mixed)]

#: SQL can express neither the learned stages nor MinHash; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    base = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
    return docs
