"""Token counts with a digest cache.

The cache is a table of content digests, tokenizer versions and counts in a
folder that Spark reads and appends to. Texts are reduced to the SHA-256 of
their bytes (null as empty), and the version is the digest of the tokenizer
file's bytes, so another file never meets counts of this one. Digests without
a stored count keep one text each; those texts alone are encoded, and their
counts are appended to the cache. Copies within a task fall together before
the shuffle, so a text that a third of all rows share costs one row per task.

Edge cases: a null text is empty; rows that repeat an id each come back; a
cache that two runs filled at once may hold a digest twice, with equal counts;
a folder that is not there yet is an empty cache; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored

#: Bytes of text that go through the tokenizer together.
RUN_BYTES = 1 << 20
_SCHEMA = "digest binary, version string, n_tokens long"
_PROCESSORS: dict = {}


def version_of(model: str) -> str:
    """The digest of a tokenizer file."""
    return hashlib.sha256(Path(model).read_bytes()).hexdigest()


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """The cache in ``folder``; empty where there is none yet."""
    try:
        return spark.read.schema(_SCHEMA).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def _processor(model: str):
    if model not in _PROCESSORS:
        import sentencepiece

        _PROCESSORS[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _PROCESSORS[model]


def _encoded(texts: DataFrame, model: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(model)
        for batch in batches:
            counts, held, size = [], [], 0
            for text in batch.column(1).to_pylist():
                held.append(text)
                size += len(text)
                if size >= RUN_BYTES:
                    counts += map(len, processor.encode(held, num_threads=1))
                    held, size = [], 0
            counts += map(len, processor.encode(held, num_threads=1)) if held else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])
    return texts.select("digest", "text").mapInArrow(scan, "digest binary, n_tokens long")


def counted(docs: DataFrame, cache: str, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row; ``cache`` is the folder of the cache."""
    spark, version = docs.sparkSession, version_of(model)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    known = cached(spark, cache).where(F.col("version") == version).select("digest")
    distinct = rows.groupBy("digest").agg(F.any_value("text").alias("text"))
    _encoded(distinct.join(known, "digest", "left_anti"), model).select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    needed = rows.select("digest").distinct()
    counts = stored(needed.join(cached(spark, cache).where(F.col("version") == version), "digest").groupBy("digest").agg(
        F.min("n_tokens").alias("n_tokens")), "token-counts")
    return rows.drop("text").join(counts, "digest").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
