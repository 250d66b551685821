"""A corpus pipeline: language ID, near-dedup, decontamination, secret redaction, piece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.folders import new_folder
from cadenza.llm import decontaminate, langid, minhash, pieces, secrets
from cadenza.llm.common import bounded_batches, documents


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier knows."""
    bounded_batches(spark)
    return langid.accepted(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    bounded_batches(spark)
    return minhash.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    bounded_batches(spark)
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): sampled pieces of every text."""
    bounded_batches(spark)
    return pieces.encode(docs)


STAGES = [("language_id", known_language), ("near_dedup", one_of_each), ("decontamination", no_benchmark), ("secret_scans", no_secrets), ("sentencepiece", encoded)]

#: SQL can't express the learned classifier, the compressor or the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written to the shared folder and read again.

    The folder, and with it the result, goes when the application ends.
    """
    root = new_folder(spark, "corpus-pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
