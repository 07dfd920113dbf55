"""Packing along a space-filling curve: neighbouring documents share sequences.

Each document's token ids are counted in hashed cells with signs, and that
vector is projected to a few dimensions. The cell of the projection's direction on a
Hilbert curve is the document's key: documents with similar tokens are near on
the curve. Encoded documents are written once, then dealt out by ranges of
(key, id), so that no task depends on how many documents share a key, and
sorted. Each task fills sequences one after the other; a document is cut where
its sequence is full. What is left at the end of a task is cut into sequences
whose lengths are powers of two, which need no padding.

Edge cases: a null or empty text has only the end id; rows that repeat an id
are each packed; null ids come first among equal keys; an empty table packs
nothing; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes, tokens
from .storage import stored

LENGTH = 1024
#: Ids that a task holds before it cuts them, besides one document.
HELD_IDS = 1 << 18
CELLS, DIMENSIONS, BITS = 256, 3, 10


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits in each dimension.

    Axes are turned into the transposed index by undoing, from the high bit
    down, the exchanges and reflections of the curve, then Gray-coding.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for k in range(n):
            swap = np.where(x[k] & high, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(x[k] & high, low, 0)
            x[0] ^= swap
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            out = (out << 1) | ((x[k] >> bit) & 1)
    return out


@functools.lru_cache(maxsize=1)
def _projected(count: int, seed: int) -> np.ndarray:
    """The projection of every id: the row of its hashed cell, with its sign."""
    h = textbytes.mixed(np.arange(1, count + 1, dtype=np.uint64))
    matrix = np.random.default_rng(seed).normal(size=(CELLS, DIMENSIONS)).astype(np.float32)
    sign = np.where(h & np.uint64(1 << 20), 1, -1).astype(np.float32)
    return matrix.T[:, (h % np.uint64(CELLS)).astype(np.int64)] * sign


def curve_keys(documents: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """The curve key of each document's ids: the direction of its projected vector, which is the sum of its ids' projections."""
    most = max((int(ids.max()) for ids in documents if len(ids)), default=0)
    rows = _projected(1 << max(16, most.bit_length()), seed)
    place = np.array([[row[ids].sum(dtype=np.float64) for row in rows] for ids in documents]).reshape(-1, DIMENSIONS)
    norm = np.linalg.norm(place, axis=1, keepdims=True)
    place /= np.where(norm == 0, 1, norm)
    return hilbert(np.clip((place + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def _encoded(docs: DataFrame, tokenizer: str, end: int, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema["id"], T.StructField("key", T.LongType()), T.StructField("ids", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # as many texts at once as the tokenizer looks up together: what they repeat is looked up once
            for first, last in textbytes.runs(textbytes.bytes_of(batch.column(1))[1], tokens.RUN_BYTES):
                part = batch.slice(first, last - first)
                found = list(tokens.encoded(part.column(1), tokenizer, end))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(curve_keys(found), pa.int64()),
                    pa.array([_short(x).tobytes() for x in found], pa.binary())], names=schema.names)
    return source.mapInArrow(scan, schema)


def _short(ids: np.ndarray) -> np.ndarray:
    """Ids in two bytes each where all fit, behind the number of bytes."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return np.concatenate((np.array([width], np.uint8), ids.astype(f"<u{width}").view(np.uint8)))


def _tail(count: int) -> list[int]:
    """The powers of two that make ``count``, the greatest first."""
    return [1 << b for b in range(count.bit_length() - 1, -1, -1) if count >> b & 1]


def cuts(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, count, sequence, offset) of the pieces of documents packed in order."""
    total = sum(sizes)
    rest = total % length
    bounds = np.cumsum([0, *[length] * (total // length), *_tail(rest)])
    out, at, sequence = [], 0, 0
    for k, size in enumerate(sizes):
        start = 0
        while start < size:
            while bounds[sequence + 1] <= at:
                sequence += 1
            count = min(size - start, int(bounds[sequence + 1]) - at)
            out.append((k, start, count, sequence, at - int(bounds[sequence])))
            start, at = start + count, at + count
    return out


def packed(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per piece of a document.

    Returns ``id_col``, ``start`` (ids of the document before the piece),
    ``length``, ``ids`` (little-endian unsigned 32-bit integers),
    ``doc_tokens`` (with the end id), ``sequence_id`` and ``offset`` in it.
    """
    found = stored(_encoded(docs, tokenizer, end, id_col, text_col), "encoded")
    ordered = found.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "ids")
    schema = T.StructType([
        T.StructField(id_col, found.schema["id"].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = TaskContext.get().partitionId() << 40, 0
        names: list = []
        held: list[np.ndarray] = []
        shown: list[int] = []  # ids of the held documents that earlier pieces have
        kind, waiting = None, 0

        def rows(last: bool) -> pa.RecordBatch:
            nonlocal done
            sizes = [len(x) - s for x, s in zip(held, shown)]
            total = sum(sizes)
            pieces = cuts(sizes, length)
            full = total // length
            take = pieces if last else [p for p in pieces if p[3] < full]
            out = pa.RecordBatch.from_arrays([
                pa.array([names[k] for k, *_ in take], kind), pa.array([shown[k] + s for k, s, *_ in take], pa.int64()),
                pa.array([n for _, _, n, _, _ in take], pa.int64()),
                pa.array([held[k][shown[k] + s:shown[k] + s + n].astype("<u4").tobytes() for k, s, n, _, _ in take], pa.binary()),
                pa.array([len(held[k]) for k, *_ in take], pa.int64()), pa.array([base + done + q for *_, q, _ in take], pa.int64()),
                pa.array([o for *_, o in take], pa.int64())], names=schema.names)
            used = [0] * len(held)
            for k, s, n, _, _ in take:
                used[k] = s + n
            keep = [k for k in range(len(held)) if used[k] < sizes[k]]
            names[:], shown[:] = [names[k] for k in keep], [shown[k] + used[k] for k in keep]
            held[:] = [held[k] for k in keep]
            done += full
            return out
        for batch in batches:
            kind = batch.column(0).type
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
                raw = memoryview(raw.as_buffer())
                names.append(name)
                held.append(np.frombuffer(raw, f"<u{raw[0]}", offset=1))
                shown.append(0)
                waiting += len(held[-1])
                if waiting >= HELD_IDS:
                    yield rows(last=False)
                    waiting = 0
        if held:
            yield rows(last=True)
    return ordered.mapInArrow(scan, schema)
