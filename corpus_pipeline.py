"""A training corpus from documents: stages in order, each over what the one before it kept.

Toxic documents go, of each group of near-duplicates one document stays,
documents that the benchmark contaminates go, and what is left is packed into
sequences. All stages but the last keep the columns of the documents and the
rows that they do not reject as they are. Null and empty texts are clean
documents; the operators' docstrings state the other edge cases.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crawlwright.llm import decontamination, packing, simhash, toxicity
from crawlwright.llm.storage import stored


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model fitted on the labelled ones among them."""
    model = toxicity.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def deduplicated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The first document of each group of near-duplicates, by op4's rule: 3-word shingles, at most 3 of 64 bits.

    That is no bound on the similarity of the shingles; the README has its measured recall.
    """
    return simhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0)


STAGES = [("toxicity", without_toxic), ("simhash", deduplicated), ("decontamination", decontaminated), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is written once and read by the next."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"after-{name}")
    return STAGES[-1][1](spark, docs, folder)
