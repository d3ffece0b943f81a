"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

The near-duplicate stage links texts by the similarity of their five-word shingles (quarry/llm/resemblance.py: op5's fingerprints, linked by
its vantage-point forests, and MinHash bands, for the many pairs that those don't find, propose; the exact Jaccard similarity of 0.8 decides).

Rows with null ids, null texts, repeated rows and extra columns pass as each stage's operator says. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, packing, quality_classifier, resemblance, substring_dedup
from quarry.llm.common import remove_folder, shared_folder, table
from quarry.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: that of the smallest id."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near copies, 0.8 or more of whose shingles of five words are the same: that of the smallest id."""
    return resemblance.drop_similar(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has."""
    return substring_dedup.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near-dedup", near), ("substring dedup", substrings), ("best-fit packing", pack)]

#: The classifier, the fingerprints and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table lies in a shared folder until the next one is written; the last one's pieces are checkpointed, so no table is left."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        remove_folder(spark, folder)
