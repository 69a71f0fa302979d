"""The corpus pipeline: languages, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the
columns of ``documents``; the last returns the encoded documents. Between
stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

import mailspark
from mailspark.llm import bpe, decontaminate, jaccard, langid, pii
from mailspark.llm.common import stage

# workers get the package's functions by value, so nothing must be installed there
cloudpickle.register_pickle_by_value(mailspark)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those without letters or likely language."""
    return langid.drop_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the smallest id stays."""
    return jaccard.drop_near_duplicates(docs, 5, 8, 10)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256``."""
    encoded = bpe.encode(docs, carry=("lang", "source"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("languages", languages), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks),
          ("personal_data", personal_data), ("tokens", tokens)]

# language model scores cannot be expressed in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
