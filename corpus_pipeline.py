"""A training corpus from `documents`: quality, language, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read back as the next one's docs. All but
the last return the columns of documents and only drop rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontam, langid, packing, quality, simhash
from ledgerlens.llm.common import table, written

#: Documents stay with at least this probability of the best grade, and of their likeliest language.
LEAST_QUALITY = 0.5
LEAST_LANGUAGE = 0.5


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably good and clean (P(grade 2) >= LEAST_QUALITY), learned from `labels`."""
    good, toxic = F.col("quality"), F.col("toxic")
    grade = F.when(good == 0, 0).when((good == 1) & (toxic == 1), 1).when((good == 1) & (toxic == 0), 2)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), grade, 3)
    return quality.select(docs, model, 2, LEAST_QUALITY)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages with probability LEAST_LANGUAGE or more."""
    return langid.select(docs, langid.fit(docs, F.lit(True)), LEAST_LANGUAGE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within 4 bits (4-word shingles) the document with the smallest id."""
    row, key = "_row_of_docs", "_key_of_docs"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    # documents without id come last; rows with the same id differ by number
    keyed = numbered.select("text", F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(row).alias("c")).alias(key))
    groups = simhash.near_duplicates(keyed, key, "text", shingle_words=4, max_bits=4)
    kept = groups.where(F.col("id") == F.col("component")).select(F.col("id.c").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048."""
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", good_documents),
    ("language identification", known_language),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: Learned models, XXH64 and BPE ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
