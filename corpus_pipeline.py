"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, secret redaction, BPE encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Null texts count as empty; empty tables pass through; repeated rows are repeated until
the second stage leaves one of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from resonant.llm import bpe, decontaminate, jaccard, quality, secrets
from resonant.llm.spark_io import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the rules reject go."""
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of linked ones stays."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: contaminated documents go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: findings are replaced by a mark, and n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document as token ids, with the digest of the text decoded from them."""
    return bpe.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_encoding", bpe_encoding),
]
#: Shingle sets, rule spans and BPE merges are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
