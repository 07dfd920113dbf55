"""Ranked lexical search: an inverted index in segments, searched by Block-Max MaxScore.

A task cuts the texts it reads into segments of about ``SEGMENT_BYTES`` and writes a row
for every term of a segment: its postings in blocks of ``BLOCK`` documents, gaps
and counts in as few bytes as the segment needs, the last document and the
greatest impact of each block, and the greatest impact of the list. Documents
of a segment are numbered by ascending id, so equal scores keep that order.

The terms of the items meet the index by a join on the term; each segment is
searched for a block of items. A list's weight times its greatest impact is
its global bound. Documents of the strongest lists are scored first and give a
threshold. Lists whose bounds together stay below it are non-essential: only
documents of the other, essential lists are candidates. Against the
non-essential lists, strongest first, a candidate is given up if its score so
far, the maximum of the block it would be in and the bounds of the weaker
lists stay below the threshold; only blocks with candidates left are decoded.
Each segment returns its best documents of an item, and the best of those
stay.

What a task holds is one segment, or one text if that is larger; the items of
a block are about ``ITEMS``; nothing is broadcast by hand, and only the two
corpus totals pass the driver.

Edge cases: a null or empty text has no terms and is found by nothing; an item
without known terms has no rows; rows that repeat an item's id are one item
with the terms of all; rows that repeat a document's id are documents of their
own, in any order where scores are equal; null ids of documents come before all
others, a null id of an item is an id; very long texts are indexed whole;
without documents or items there are no rows; other columns are not read.
Ids of documents are integers.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textbytes
from .storage import stored

BLOCK = 128
SEGMENT_BYTES = 16 << 20
ITEMS = 256
BEST = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[:0x80] = [chr(c).isalnum() for c in range(0x80)]
_FOLD = bytes(ord(chr(c).lower()) if c < 0x80 and _INSIDE[c] else c if _INSIDE[c] else 0x20 for c in range(256))
_INDEX = T.StructType([
    T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()),
    T.StructField("gaps", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("last", T.BinaryType()),
    T.StructField("top", T.BinaryType())])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds for each unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def lengths_over_mean(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A document's length in hundredths of the mean, half of it fixed."""
    return 100 - 50 + (50 * n * documents) // terms


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbytes.bytes_of(batch.column(0))
            sizes = [np.bincount(textbytes.spans(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], _INSIDE)[2], minlength=b - a)
                     for a, b in textbytes.runs(offsets)]
            sizes = np.concatenate(sizes or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])], names=["n", "l"])
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(scan, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return int(found[0] or 0), int(found[1] or 0)


# ---------------------------------------------------------------------- index

def _narrow(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The values in as few bytes as the greatest needs, as bytes, and that width."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    return values.astype(f"<u{width}"), width


def _binaries(values: np.ndarray, bounds: np.ndarray, width: int) -> pa.Array:
    """Slices of one array as binary values, each behind a byte that says the width."""
    sizes = (bounds[1:] - bounds[:-1]) * width
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.empty(offsets[-1], np.uint8)
    inside = np.ones(len(out), bool)
    inside[offsets[:-1]] = False
    out[~inside] = width
    out[inside] = values.view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _values(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def segment_rows(segment: int, ids: list, texts: list[bytes], documents: int, terms: int) -> pa.RecordBatch:
    """The index rows of some texts; the row of the empty term holds ids and lengths."""
    by = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    words = [texts[k].translate(_FOLD).split() for k in by]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(n.sum()))
    del words
    names = list(number)
    key, tf = np.unique(flat * len(by) + np.repeat(np.arange(len(by)), n), return_counts=True)
    term, doc = np.divmod(key, max(1, len(by)))
    gain = impact(tf, lengths_over_mean(n[doc], documents, terms))
    bounds = np.searchsorted(term, np.arange(len(names) + 1))
    first = np.zeros(len(doc), bool)
    first[bounds[:-1]] = True
    gaps, gap_width = _narrow(np.where(first, doc, doc - np.concatenate(([0], doc[:-1]))) if len(doc) else doc)
    counts, count_width = _narrow(tf)
    blocks = -(-(bounds[1:] - bounds[:-1]) // BLOCK)
    block_bounds = np.concatenate(([0], np.cumsum(blocks)))
    starts = np.repeat(bounds[:-1], blocks) + BLOCK * (np.arange(block_bounds[-1]) - np.repeat(block_bounds[:-1], blocks))
    ends = np.minimum(starts + BLOCK, np.repeat(bounds[1:], blocks))
    last, last_width = _narrow(doc[ends - 1])
    top, top_width = _narrow(np.maximum.reduceat(gain, starts) if len(starts) else gain)
    own = np.array([ids[k] or 0 for k in by], np.int64).view(np.uint64)
    whole = np.array([0, len(by)])
    known, known_width = _narrow(np.array([ids[k] is not None for k in by], np.int64))

    def column(values: np.ndarray, at: np.ndarray, width: int, extra: np.ndarray, extra_width: int) -> pa.Array:
        return pa.concat_arrays([_binaries(values, at, width), _binaries(extra, whole if len(extra) else whole * 0, extra_width)])
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(names) + 1, segment)), pa.array([*(x.decode() for x in names), ""], pa.string()),
        pa.array(np.append(bounds[1:] - bounds[:-1], 0)), column(gaps, bounds, gap_width, own, 8),
        column(counts, bounds, count_width, n.astype("<u8"), 8), column(last, block_bounds, last_width, known, known_width),
        column(top, block_bounds, top_width, np.zeros(0, np.uint8), 1)], names=_INDEX.names)


def indexed(docs: DataFrame, documents: int, terms: int, id_col: str = "doc_id", text_col: str = "text",
            segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The inverted index of all texts: a row for each segment and term."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).fill_null(b"")):
                ids.append(key)
                texts.append(text.as_py())
                size += len(texts[-1]) + 16
                if size >= segment_bytes:
                    yield segment_rows(place, ids, texts, documents, terms)
                    place, ids, texts, size = place + 1, [], [], 0
        if ids:
            yield segment_rows(place, ids, texts, documents, terms)
    return stored(source.mapInArrow(scan, _INDEX), "lexical-index")


# --------------------------------------------------------------------- search

class Postings:
    """A term's list in a segment; blocks are decoded when they are asked for, once."""

    def __init__(self, gaps: bytes, counts: bytes, last: bytes, top: bytes, m: np.ndarray) -> None:
        self.gaps, self.counts = _values(gaps), _values(counts)
        self.last, self.top = _values(last).astype(np.int64), _values(top).astype(np.int64)
        self.m = m
        self.docs = np.repeat(self.last, BLOCK)[:len(self.gaps)]  # a block not yet decoded stands for its last document
        self.gains = np.zeros(len(self.gaps), np.int64)
        self.decoded = np.zeros(len(self.last), bool)
        self.best = int(self.top.max())

    def decode(self, blocks: np.ndarray | None = None) -> None:
        """Decode these blocks, or all."""
        new = np.flatnonzero(~self.decoded) if blocks is None else np.unique(blocks[~self.decoded[blocks]])
        self.decoded[new] = True
        if len(new) == len(self.last):
            self.docs[:] = np.cumsum(self.gaps, dtype=np.int64)
            self.gains[:] = impact(self.counts.astype(np.int64), self.m[self.docs])
            return
        for b in new.tolist():
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            self.docs[part] = np.cumsum(self.gaps[part], dtype=np.int64)
            if b:  # the gap of a block's first document is from the last one of the block before
                self.docs[part] += self.last[b - 1]
            self.gains[part] = impact(self.counts[part].astype(np.int64), self.m[self.docs[part]])

    def gains_of(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Impact of each document, 0 where it is not in the list; its block is given."""
        self.decode(block)
        at = np.searchsorted(self.docs, docs)
        return np.where(self.docs[at] == docs, self.gains[at], 0)


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores above 0, equal ones by document."""
    return np.lexsort((docs, -scores))[:min(k, int((scores > 0).sum()))]


def search(lists: list[tuple[int, Postings]], size: int, k: int = BEST) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best in a segment of ``size`` documents, from (weight, list) of each term."""
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * x[1].best)
    bounds = np.array([w * p.best for w, p in lists], np.int64)
    below = np.concatenate(([0], np.cumsum(bounds)))  # all bounds of the lists weaker than each
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def scored(candidate: np.ndarray, essential: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that may reach the threshold, with their scores; the lists from ``essential`` on are decoded."""
        score = np.zeros(size, np.int64)
        for w, p in lists[essential:]:
            score[p.docs] += w * p.gains
        docs = np.flatnonzero(candidate)
        score = score[docs]
        for at in range(essential - 1, -1, -1):
            w, p = lists[at]
            block = np.searchsorted(p.last, docs)
            inside = block < len(p.last)
            most = np.zeros(len(docs), np.int64)
            most[inside] = w * p.top[block[inside]]
            alive = score + most + below[at] >= threshold
            docs, score, block, inside = docs[alive], score[alive], block[alive], inside[alive]
            if inside.any():
                score[inside] += w * p.gains_of(docs[inside], block[inside])
        return docs, score
    first, strong = np.zeros(size, bool), len(lists)
    while strong > 0 and np.count_nonzero(first) < k:
        strong -= 1
        lists[strong][1].decode()
        first[lists[strong][1].docs] = True
    docs, score = scored(first, strong, 1)
    best = _best(score, docs, k)
    if len(best) == k:
        threshold = int(score[best[-1]])
        essential = int(np.searchsorted(below, threshold, side="left")) - 1  # the weaker lists' bounds stay below the threshold
        if essential < strong:
            rest = np.zeros(size, bool)
            for _, p in lists[essential:strong]:
                p.decode()
                rest[p.docs] = True
            more, gained = scored(rest & ~first, essential, threshold)
            docs, score = np.concatenate((docs, more)), np.concatenate((score, gained))
            best = _best(score, docs, k)
    return docs[best], score[best]


def queries_of(items: DataFrame, index: DataFrame, documents: int, item_col: str, text_col: str, items_each: int) -> DataFrame:
    """``block``, ``term``, ``weight`` and ``items`` with the term; the empty term stands once for each block."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    term = F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), upper, lower), F.lit(TERM), F.lit(0))))
    terms = stored(items.select(F.col(item_col).alias("item"), term.alias("term")).distinct(), "lexical-terms")
    count = terms.select("item").distinct().count()
    block: Column = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-count // items_each))))
    df = index.where("term != ''").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    per_term = terms.groupBy(block.alias("block"), "term").agg(F.collect_list(F.struct("item")).alias("items"))
    found = per_term.join(df, "term").select("block", "term", weight.alias("weight"), "items")
    return found.unionByName(found.groupBy("block").agg(F.lit("").alias("term"), F.lit(0).cast("long").alias("weight"),
                                                        F.first("items").alias("items")))


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, items_each: int = ITEMS) -> DataFrame:
    """The documents with the highest scores above 0 for each item: ``item_col``, ``rank`` (from 1), ``id_col`` and ``score``."""
    documents, terms = totals(docs, text_col)
    key, name = items.schema[item_col].dataType, docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("item", key), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    if not documents:
        found = docs.sparkSession.createDataFrame([], schema)
    else:
        index = indexed(docs, documents, terms, id_col, text_col, segment_bytes)
        key_type = to_arrow_type(key)
        asked = queries_of(items, index, documents, item_col, item_text_col, items_each)

        def scan(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            own = next(r for r in rows if r["term"] == "")
            ids, n, known = _values(own["gaps"]).view(np.int64), _values(own["counts"]).astype(np.int64), _values(own["last"])
            m = lengths_over_mean(n, documents, terms)
            wanted: dict[object, list[tuple[int, Postings]]] = defaultdict(list)
            for r in rows:
                if r["term"]:
                    postings = Postings(r["gaps"], r["counts"], r["last"], r["top"], m)
                    for item in r["items"]:
                        wanted[item["item"]].append((r["weight"], postings))
            parts = []
            for item, lists in wanted.items():
                at, score = search(lists, len(ids), best)
                parts.append(pa.Table.from_arrays([
                    pa.array([item] * len(at), key_type), pa.array(ids[at], mask=known[at] == 0), pa.array(score)], names=schema.names))
            return pa.concat_tables(parts) if parts else pa.table({f.name: pa.array([], t) for f, t in zip(schema, (key_type, pa.int64(), pa.int64()))})
        found = index.join(asked, "term").groupBy("block", "segment").applyInArrow(scan, schema)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= best).select(
        F.col("item").alias(item_col), "rank", F.col("id").cast(name).alias(id_col), "score")
