"""Benchmark decontamination: a broadcast set of normalised word windows, scanned over every text.

Words are runs of ASCII letters, digits and all non-ASCII characters, with A-Z
in lower case. Each benchmark item gives all its windows of ``n`` consecutive
words; an item with fewer words, but not none, is one window. The windows'
hashes are broadcast and looked up for every window of every text; a hit is
verified word by word, so a hash collision marks nothing.

The broadcast is bounded: the benchmark is measured first and, where its text
exceeds ``block_bytes``, cut into blocks by a hash of the row. Texts then pass
the blocks one after the other in the same tasks, without a shuffle, and the
findings add up. Nothing is joined or grouped, so equal texts, hot sources
and frequent passages cost no more than others.

Edge cases: a null text has no words; rows of the benchmark with a null id or
text give no window; repeated rows are each judged on their own; an empty
benchmark marks nothing; other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes

#: Benchmark text that is broadcast at once.
BLOCK_BYTES = 8 << 20
#: A text is contaminated when one of so many words is hit.
PARTS = 20
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0"):ord("9") + 1] = _WORD[ord("a"):ord("z") + 1] = _WORD[128:] = True
_BITS = 22


class WindowSet:
    """The windows of some benchmark items: hashes for the search, words for the proof."""

    def __init__(self, items: list[tuple[object, str]], n: int) -> None:
        self.n, self.words = n, {}
        by_length: dict[int, list[np.ndarray]] = {}
        data, offsets = textbytes.bytes_of(pa.array([t for _, t in items], pa.large_string()))
        for first, last in textbytes.runs(offsets):
            run = Words(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
            bounds = np.searchsorted(run.text, np.arange(last - first + 1))
            for k in range(last - first):
                a, b = int(bounds[k]), int(bounds[k + 1])
                size = min(n, b - a)
                if not size:
                    continue
                hashes = textbytes.window_hashes(run.hashes[a:b], size)
                by_length.setdefault(size, []).append(hashes)
                for i, h in enumerate(hashes.tolist()):
                    known = self.words.setdefault((size, h), {})
                    known.setdefault(run.joined(a + i, size), set()).add(items[first + k][0])
        self.hashes = {size: np.unique(np.concatenate(found)) for size, found in by_length.items()}
        self.seen = {}
        for size, found in self.hashes.items():
            self.seen[size] = np.zeros(1 << _BITS, dtype=bool)
            self.seen[size][(found >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, run: Words) -> Iterator[tuple[int, int, set]]:
        """(first word, words, items) of every window of ``run`` that is in the set."""
        for size, known in self.hashes.items():
            found = textbytes.window_hashes(run.hashes, size)
            at = np.flatnonzero(self.seen[size][(found >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[run.text[at] == run.text[at + size - 1]]
            place = np.searchsorted(known, found[at])
            at = at[known[np.minimum(place, len(known) - 1)] == found[at]]
            for i in at.tolist():
                items = self.words[size, int(found[i])].get(run.joined(i, size))
                if items:
                    yield i, size, items


class Words:
    """The normalised words of a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = textbytes.lowered(data)
        self.starts, self.ends, self.text = textbytes.spans(self.data, offsets, _WORD)
        self.hashes = textbytes.span_hashes(self.data, self.starts, self.ends)

    def joined(self, first: int, n: int) -> bytes:
        low = self.starts[first]
        part = self.data[low:self.ends[first + n - 1]].tobytes()
        return b" ".join(part[s - low:e - low] for s, e in zip(self.starts[first:first + n].tolist(),
                                                             self.ends[first:first + n].tolist()))


def _judged(column: pa.Array, windows: list[WindowSet]) -> Iterator[tuple[int, int, set, list[tuple[int, int]]]]:
    """(words, hit words, items, byte spans hit) of each text."""
    data, offsets = textbytes.bytes_of(column)
    for first, last in textbytes.runs(offsets):
        local = offsets[first:last + 1] - offsets[first]
        run = Words(data[offsets[first]:offsets[last]], local)
        change = np.zeros(len(run.starts) + 1, dtype=np.int64)
        items: dict[int, set] = {}
        for block in windows:
            for i, size, found in block.hits(run):
                change[i] += 1
                change[i + size] -= 1
                items.setdefault(int(run.text[i]), set()).update(found)
        hit = np.cumsum(change[:-1]) > 0
        words = np.bincount(run.text, minlength=last - first)
        hits = np.bincount(run.text[hit], minlength=last - first)
        bounds = np.searchsorted(run.text, np.arange(last - first + 1))
        for k in range(last - first):
            cut: list[tuple[int, int]] = []
            if hits[k]:
                a, b = bounds[k], bounds[k + 1]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False])).astype(np.int8)))
                cut = [(int(run.starts[a + s] - local[k]), int(run.ends[a + e - 1] - local[k]))
                       for s, e in edges.reshape(-1, 2).tolist()]
            yield int(words[k]), int(hits[k]), items.get(k, set()), cut


def _windows(docs: DataFrame, benchmark: DataFrame, n: int, item: str, text: str, block_bytes: int) -> list:
    """The benchmark's window sets, each broadcast on its own; their number follows its measured size."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).dropna()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    context = docs.sparkSession.sparkContext
    return [context.broadcast(WindowSet([tuple(r) for r in rows.where(
        F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()], n)) for k in range(blocks)]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What each text shares with the benchmark.

    Returns ``id_col``, ``n_words``, ``n_hit`` (words inside any occurrence of
    a window), ``items`` (distinct ids of items with occurring windows, as
    strings in string order) and ``spans`` (byte offsets of the hit stretches in the
    UTF-8 text).
    """
    windows = _windows(docs, benchmark, n, item_col, item_text_col, block_bytes)
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([
        source.schema[0], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                         T.StructField("end", T.LongType())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [w.value for w in windows]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = list(_judged(batch.column(1), sets))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
                pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                pa.array([[{"start": s, "end": e} for s, e in x[3]] for x in found], kind)],
                names=[f.name for f in schema.fields])
    return source.mapInArrow(scan, schema)


def is_contaminated(parts: int = PARTS) -> Column:
    """The rule over ``n_hit`` and ``n_words``: a word is hit, and at least one in ``parts``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * parts >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, parts: int = PARTS, remove: str = "documents",
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all columns, without what the benchmark contaminates.

    ``remove="documents"`` drops each text of which one word in ``parts`` is hit, or more,
    and keeps all others as they are; ``remove="spans"`` keeps
    every row and cuts the hit stretches out of such texts, a blank in place
    of each.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    windows = _windows(docs, benchmark, n, item_col, item_text_col, block_bytes)
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [w.value for w in windows]
        for batch in batches:
            found = list(_judged(batch.column(at), sets))
            bad = [hit > 0 and parts * hit >= words for words, hit, _, _ in found]
            if remove == "documents":
                yield batch.filter(pa.array([not x for x in bad], pa.bool_()))
                continue
            texts = batch.column(at).to_pylist()
            for k in np.flatnonzero(bad).tolist():
                raw, out, low = texts[k].encode(), [], 0
                for start, end in found[k][3]:
                    out.append(raw[low:start])
                    low = end
                texts[k] = b" ".join([*out, raw[low:]]).decode()
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return docs.mapInArrow(scan, docs.schema)
