"""Token-id files with fixed-width bit packing.

Texts are encoded in ascending order of their id: rows are dealt out by ranges
of ids, so each task writes one shard and shards follow each other. A shard is
a sequence of segments, one row each, of whole documents. A segment stores
each id in the fewest bits that the vocabulary needs, in blocks of
``BLOCK_IDS`` ids that begin at byte offsets it lists; numpy unpacks a block
at once, and a stretch of ids needs only the blocks that hold it. Segments are
rows of Parquet files, so any store that Spark writes to holds them, and the
writer's commit leaves no half-written shard when an executor is lost.

Layout of a row: ``shard``, ``segment``, ``first`` (ids of the shard before
the segment), ``n_ids``, ``bits``, ``doc_ids``, ``doc_starts`` (ids of the
segment before each document), ``block_offsets``, ``payload``. Bit ``j`` of
the block's ``i``-th id is bit ``i * bits + j`` of the block, low bits first.

Edge cases: a null or empty text has only the end id; null ids come first;
rows that repeat an id are each written, in order of their texts; an empty
table gives an empty folder; other columns are not read. Memory follows a
segment, or one document where that is longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

BLOCK_IDS = 4096
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 18


def packed(ids: np.ndarray, bits: int) -> tuple[bytes, list[int]]:
    """(payload, byte offsets of the blocks) of ids that need at most ``bits`` bits each."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    out, offsets = [], [0]
    for first in range(0, len(ids), BLOCK_IDS):
        block = ids[first:first + BLOCK_IDS]
        if bits in (8, 16, 32):
            part = block.astype(f"<u{bits // 8}").tobytes()
        else:
            flags = (block[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
            part = np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()
        out.append(part)
        offsets.append(offsets[-1] + len(part))
    return b"".join(out), offsets[:-1]


def unpacked(payload: bytes, offsets: list[int], bits: int, n_ids: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids from position ``start`` on; only the blocks that hold them are touched."""
    stop = n_ids if count is None else min(n_ids, start + count)
    if stop <= start:
        return np.zeros(0, np.uint32)
    found = []
    for block in range(start // BLOCK_IDS, -(-stop // BLOCK_IDS)):
        size = min(BLOCK_IDS, n_ids - block * BLOCK_IDS)
        raw = np.frombuffer(payload, np.uint8, (size * bits + 7) // 8, offsets[block])
        if bits in (8, 16, 32):
            found.append(raw.view(f"<u{bits // 8}").astype(np.uint32))
        else:
            flags = np.unpackbits(raw, count=size * bits, bitorder="little").reshape(size, bits)
            found.append(flags.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32)))
    low = start // BLOCK_IDS * BLOCK_IDS
    return np.concatenate(found)[start - low:stop - low]


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the files of all rows of ``docs`` to ``folder``; ``tokenizer`` is the path of a tokenizer file."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("first", T.LongType()),
        T.StructField("n_ids", T.LongType()), T.StructField("bits", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(source.schema["id"].dataType)), T.StructField("doc_starts", T.ArrayType(T.LongType())),
        T.StructField("block_offsets", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        bits = max(tokens.encoder(tokenizer).vocabulary - 1, end).bit_length()
        names, held, size, kind = [], [], 0, None

        def row() -> pa.RecordBatch:
            payload, offsets = packed(np.concatenate(held), bits)
            starts = np.cumsum([0, *map(len, held[:-1])]).tolist()
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                pa.array([size], pa.int64()), pa.array([bits], pa.int32()), pa.array([names], pa.list_(kind)),
                pa.array([starts], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                pa.array([payload], pa.binary())], names=schema.names)
        for batch in batches:
            kind = batch.column(0).type
            for name, ids in zip(batch.column(0).to_pylist(), tokens.encoded(batch.column(1), tokenizer, end)):
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield row()
                    segment, first, names, held, size = segment + 1, first + size, [], [], 0
        if held:
            yield row()
    ordered.mapInArrow(scan, schema).write.parquet(folder)


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: ``id_col``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``.

    ``ids`` holds little-endian unsigned 32-bit integers. Only one row per
    shard is put in order for ``start``.
    """
    segments = spark.read.parquet(folder)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    rows = segments.join(F.broadcast(bases), "shard").select(  # one row per task that wrote
        (F.col("base") + F.col("first")).alias("first"), "n_ids", "bits", "doc_ids", "doc_starts", "block_offsets", "payload")
    schema = T.StructType([T.StructField(id_col, segments.schema["doc_ids"].dataType.elementType),
                           T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("doc_ids").type.value_type
            for k in range(batch.num_rows):
                first, n, bits, names, starts, offsets, payload = (batch.column(c)[k].as_py() for c in range(7))
                ids = unpacked(payload, offsets, bits, n).astype("<u4")
                ends = [*starts[1:], n]
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, kind), pa.array([first + s for s in starts], pa.int64()),
                    pa.array([e - s for s, e in zip(starts, ends)], pa.int64()),
                    pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())], names=schema.names)
    return rows.mapInArrow(scan, schema)


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
