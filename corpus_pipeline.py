"""The corpus pipeline: toxicity, exact de-duplication, near de-duplication, benchmark decontamination, source mixing.

Each stage is (spark, docs, sf_dir) -> DataFrame and calls one operator of veriloom.llm. Its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import common, decontamination, exact_dedup, mixing, simhash, toxicity
from veriloom.llm.queries import toxicity_model


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier takes for toxic go."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir))


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by SimHash over shingles of five words, the document with the smallest doc_id stays."""
    return simhash.near_dedup(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, whole or edited, go."""
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mixture of its sources takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", exact_copies_out),
    ("SimHash near-dedup", near_copies_out),
    ("benchmark decontamination", benchmark_out),
    ("mixing sources", mixed),
]

#: Trained dictionaries, 64-bit votes and alignments have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage returns is written beside the checkpoints, which all executors share."""
    docs, folder = common.table(spark, sf_dir, "documents"), f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
