"""Language-model scores with stupid backoff, from count tables over the whole corpus.

Texts are cut into words and kept in blocks of some megabytes. The n-grams of
each block, each once with its count there, are the exploded side. It is
partitioned by ranges of the n-gram's hash, its buckets, and travels there as
one array per block and bucket. Exploded in its bucket, every n-gram meets its
sum over all blocks, the count table, in one sorted pass. A block gets back
the totals alone, in the order of its own distinct n-grams, scores its
documents and sums them up. However often an n-gram occurs, it is one row per
block, so frequent words are no hot keys.

A document is scored against all other documents: its own counts are taken
off. A word with ``c`` of its n-gram and ``C`` of the context before it scores
``c / C``; where ``c`` is 0, the next shorter context serves, times
``backoff``; a word alone scores ``c / N`` with ``N`` all words of the others,
and half a count where it has none.

Edge cases: words are those of the decontamination operator; a text without
words (null, empty, signs only) has 0 words and the score 0; repeated rows are
documents of their own; a corpus of one document has no counts but its halves;
a very long text is a block of its own; many empty texts are cut into blocks by
their number; an empty table gives no rows; other columns are not read. Words
and n-grams are told apart by 64-bit hashes, which are not checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes
from .decontamination import Words
from .storage import stored

#: Bytes of text in a block.
BLOCK_BYTES = 32 << 20
#: Texts in a block at most, be they empty.
BLOCK_ROWS = 1_000_000
#: Words of a block that are scored together; a longer text is scored on its own.
PART_WORDS = 1 << 19
#: N-grams of all blocks in a bucket, about.
BUCKET_GRAMS = 500_000
BACKOFF = 0.4


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, as the high ones of small numbers and differences are mostly zero."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of texts: ids, words per text, the distinct word hashes and each word's place among them."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(source.schema["id"].dataType)),
        T.StructField("sizes", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("places", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sizes, hashes, size, kind = TaskContext.get().partitionId() << 32, [], [], [], 0, None

        def row() -> pa.RecordBatch:
            words, places = np.unique(np.concatenate(hashes), return_inverse=True)
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([_pack(np.concatenate(sizes))], pa.binary()),
                pa.array([_pack(np.diff(words, prepend=np.uint64(0)))], pa.binary()), pa.array([_pack(places.astype(np.uint32))], pa.binary())], names=schema.names)
        for batch in batches:
            kind = batch.column(0).type
            data, offsets = textbytes.bytes_of(batch.column(1))
            for first, last in textbytes.runs(offsets):
                run = Words(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                ids += batch.column(0).slice(first, last - first).to_pylist()
                sizes.append(np.bincount(run.text, minlength=last - first).astype(np.int64))
                hashes.append(run.hashes)
                size += int(offsets[last] - offsets[first])
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                    yield row()
                    block, ids, sizes, hashes, size = block + 1, [], [], [], 0
        if ids:
            yield row()
    return source.mapInArrow(scan, schema)


class _Block:
    """The n-grams of a block."""

    def __init__(self, sizes: np.ndarray, hashes: np.ndarray) -> None:
        self.sizes, self.hashes = sizes, hashes
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    @classmethod
    def unpacked(cls, sizes: bytes, words: bytes, places: bytes) -> _Block:
        return cls(_unpack(sizes, np.int64), np.cumsum(_unpack(words, np.uint64), dtype=np.uint64)[_unpack(places, np.uint32)])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of their last words, hashes) of the n-grams of ``n`` words, none across texts."""
        inside = self.text[n - 1:] == self.text[:max(0, len(self.text) - n + 1)]
        grams = textbytes.mixed(textbytes.window_hashes(self.hashes, n) + np.uint64(n))
        return (np.flatnonzero(inside) + n - 1).astype(np.int32), grams[inside]

    def scores(self, totals: list[np.ndarray], corpus: int, backoff: float) -> np.ndarray:
        """The summed logarithms of each text; ``totals`` are of the distinct n-grams of each length, in their order."""
        known = []
        for n, total in enumerate(totals, 1):
            distinct = np.unique(self.grams(n)[1])
            if len(distinct) != len(total):
                raise ValueError(f"{len(total)} totals for {len(distinct)} n-grams of {n} words")
            known.append((distinct, total))
        ends, out = np.concatenate(([0], np.cumsum(self.sizes))), [np.zeros(0)]
        for first, last in textbytes.runs(ends, PART_WORDS):
            out.append(_Block(self.sizes[first:last], self.hashes[ends[first]:ends[last]])._scores(known, corpus, backoff))
        return np.concatenate(out)

    def _scores(self, known: list[tuple[np.ndarray, np.ndarray]], corpus: int, backoff: float) -> np.ndarray:
        """As :meth:`scores`, of some texts of the block whose distinct n-grams and totals are ``known``."""
        place = np.arange(len(self.hashes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        steps = np.minimum(place, len(known) - 1).astype(np.int32)  # words of context there could be
        del place
        out = shorter = np.zeros(0)
        for n, (distinct, total) in enumerate(known, 1):
            count = self._others(n, distinct, total)
            if n == 1:
                others = np.maximum(corpus - self.sizes, 1)
                out = np.log(np.maximum(count, 0.5) / others[self.text]) + steps * math.log(backoff)
            else:
                has = np.flatnonzero(count > 0)
                out[has] = np.log(count[has] / shorter[has - 1]) + (steps[has] - n + 1) * math.log(backoff)
            shorter = count
        return np.bincount(self.text, weights=out, minlength=len(self.sizes)).astype(np.float64)

    def _others(self, n: int, distinct: np.ndarray, total: np.ndarray) -> np.ndarray:
        """How often the n-gram that ends at each word stands in other texts; 0 where there is none."""
        ends, grams = self.grams(n)
        count = np.zeros(len(self.hashes))
        if len(grams):
            which = np.searchsorted(distinct, grams)
            count[ends] = total[which]
            which *= len(self.sizes)
            which += self.text[ends]
            _, pair, here = np.unique(which, return_inverse=True, return_counts=True)
            count[ends] -= here[pair]
        return count


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; the order of hashes is the order of buckets."""
    return ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _answers(batches: Iterator[pa.RecordBatch], least: int = BUCKET_GRAMS) -> Iterator[pa.RecordBatch]:
    """Whole buckets of ``least`` rows or more to one row of each block and length: first bucket, totals in the order of hashes."""
    names = ["bucket", "block", "length", "gram", "total"]

    def row(rows: list[np.ndarray]) -> pa.RecordBatch:
        bucket, block, length, gram, total = rows
        order = np.lexsort((gram.view(np.uint64), length, block))
        block, length = block[order], length[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(block) != 0) | (np.diff(length) != 0))))
        return pa.RecordBatch.from_arrays([
            pa.array(block[first]), pa.array(bucket[order][first]), pa.array(length[first]),
            pa.array([_pack(x) for x in np.split(total[order], first[1:])], pa.binary())], names=["block", "bucket", "length", "totals"])
    kept, size, open_bucket = [], 0, None
    for batch in batches:
        new = [batch.column(name).to_numpy(zero_copy_only=False) for name in names]
        if not len(new[0]):
            continue
        if size >= least and new[0][-1] != open_bucket:  # a bucket ends in this batch
            cut = int(np.searchsorted(new[0], new[0][-1]))
            yield row([np.concatenate([*x, y[:cut]]) for x, y in zip(zip(*kept), new)])
            kept, size, new = [], 0, [y[cut:] for y in new]
        kept.append([y.copy() for y in new])
        size, open_bucket = size + len(new[0]), new[0][-1]
    if kept:
        yield row([np.concatenate(x) for x in zip(*kept)])


def scored(docs: DataFrame, order: int = 2, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``log_score`` (natural logarithm, summed) and ``mean_log_score`` of every row."""
    blocks = stored(_blocks(docs, id_col, text_col), "blocks")
    kind = blocks.schema["ids"].dataType.elementType

    corpus = blocks.select("sizes").mapInArrow(_corpus_size, "n long").agg(F.sum("n")).first()[0] or 0
    buckets = 1 + order * corpus // BUCKET_GRAMS

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                own = _Block.unpacked(*(batch.column(c)[k].as_py() for c in range(1, 4)))
                for n in range(1, order + 1):
                    distinct, counts = np.unique(own.grams(n)[1], return_counts=True)
                    bucket = _bucket(distinct, buckets)
                    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    edges = pa.array(np.append(starts, len(distinct)).astype(np.int32))
                    rows = pa.RecordBatch.from_arrays([
                        pa.array(bucket[starts]), pa.array(np.full(len(starts), name, np.int64)), pa.array(np.full(len(starts), n, np.int32)),
                        pa.ListArray.from_arrays(edges, pa.array(distinct.view(np.int64))),
                        pa.ListArray.from_arrays(edges, pa.array(counts.astype(np.int32)))],
                        names=["bucket", "block", "length", "gram", "n"])
                    step = 1 + len(starts) * BUCKET_GRAMS // (1 + len(distinct))
                    for first in range(0, len(starts), step):
                        yield rows.slice(first, step)
    parts = blocks.select("block", "sizes", "words", "places").mapInArrow(
        explode, "bucket long, block long, length int, gram array<long>, n array<int>").repartition("bucket")
    # rows stay in their bucket's partition when they are exploded, so the sums need no further exchange
    grams = parts.select("bucket", "block", "length", F.inline(F.arrays_zip("gram", "n")))
    total = F.sum("n").over(Window.partitionBy("bucket", "length", "gram"))
    answers = grams.select("bucket", "block", "length", "gram", total.alias("total")).sortWithinPartitions("bucket").mapInArrow(
        _answers, "block long, bucket long, length int, totals binary")
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_words", T.LongType()),
                           T.StructField("log_score", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right, totals = right.sort_by("bucket"), []
        for n in range(1, order + 1):
            packed = right.filter(pc.equal(right["length"], n)).column("totals").to_pylist()
            totals.append(np.concatenate([np.zeros(0, np.int64)] + [_unpack(x, np.int64) for x in packed]))
        out = []
        for k in range(left.num_rows):
            own = _Block.unpacked(*(left.column(c)[k].as_py() for c in ("sizes", "words", "places")))
            out.append(pa.table([left.column("ids").combine_chunks()[k].values, pa.array(own.sizes),
                                 pa.array(own.scores(totals, corpus, backoff))], names=schema.names))
        empty = pa.table([pa.array([], left.schema.field("ids").type.value_type), pa.array([], pa.int64()), pa.array([], pa.float64())],
                         names=schema.names)
        return pa.concat_tables(out) if out else empty
    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    return found.select("*", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0).alias("mean_log_score"))


def _corpus_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(_unpack(x.as_py(), np.int64).sum()) for x in batch.column(0)], pa.int64())],
                                         names=["n"])
