"""Corpus pipeline: five stages from raw documents to token ids.

Every stage but the last returns the columns of documents. A stage that deletes
text sets n_chars anew; documents left without a word by it go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm import decontaminate, line_dedup, near_dup, quality_rules, sentencepiece_lattice
from kinspark.llm.text import BLANK_WORD
from kinspark.session import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs deleted; documents that lose every word go."""
    x = line_dedup.shorten(docs)
    x = x.where((F.col("__deleted") == 0) | F.col("text").rlike(BLANK_WORD))
    length = F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return x.select(*[F.when(F.col("__deleted") == 0, F.col(c)).otherwise(length).alias(c) if c == "n_chars" else c for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five words, 0.8)."""
    return near_dup.thin(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids."""
    x = sentencepiece_lattice.encode(docs.select("doc_id", "text"))
    return x.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_lines),
    ("minhash_near_dup", one_of_each),
    ("decontaminate", without_benchmark),
    ("sentencepiece", to_ids),
]

#: The learned rules and the lattice are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
