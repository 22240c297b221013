"""The corpus pipeline: each stage reads what the stage before it kept.

Counted as part of the training-data subpackage; without it this file goes too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, jaccard_join, mixing, packing, quality, suffix_dedup
from quillon.shipping import ship_package

#: Bytes of a repeated string that is cut out: a passage of fifty words is longer.
REPEAT_BYTES = suffix_dedup.PASSAGE
REPEAT_GRAM = 128


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship_package(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (five words, similarity 0.8)."""
    ship_package(spark)
    return jaccard_join.keep_one(docs, k=5, percent=80)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    ship_package(spark)
    out = suffix_dedup.remove_repeats(docs, length=REPEAT_BYTES, gram=REPEAT_GRAM).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights, a row for each copy taken of a document."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    ship_package(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier or the draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, f"pipeline-{i}")
    return docs
