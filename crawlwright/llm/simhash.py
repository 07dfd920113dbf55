"""SimHash near-duplicates through deletion-variant signatures.

Texts are lower-cased (A-Z), cut into words at ASCII white space and into
shingles of consecutive words, repeats included. A fingerprint bit is set when
it is set in over half of the shingles' XXH64 hashes.

Two fingerprints that differ in at most ``distance`` bits agree, up to one
bit, in one of ``(distance + 1) / 2`` segments, half as many as an index of
equal segments needs. Each segment is indexed once for each of its bits with
that bit wiped, so those two share a variant: an equality join finds the pair
and the whole fingerprints verify it. Equal fingerprints are one node, so
copies never meet each other.

A verified pair leaves the join exactly once, whichever variants it shares.
The members of a variant differ from each other, and only in the bits that the
variant leaves open; a variant with many of them is a join key like any other,
which Spark's skew handling splits.

Edge cases: a null or empty text has fingerprint zero and links like any other;
a text shorter than a shingle is one shingle; repeated rows each come back;
a null id never names a component (where a component has no other, its id is
null); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected
from .storage import stored

SEED = 42
_ROWS = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    del words
    n, totals, digest = len(ends) - size + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for first in range(0, n, _ROWS):
        last = min(n, first + _ROWS)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(
            starts[first:last].tolist(), ends[first + size - 1:last + size - 1].tolist())), "<u8", last - first)
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * totals > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``id_col`` and ``fingerprint`` (the 64 bits as a long) of every row, and after them the values of ``more``."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), *more)
    schema = T.StructType([source.schema[0], T.StructField("fingerprint", T.LongType()), *source.schema[2:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=schema.names)
    return source.mapInArrow(scan, schema)


def _piece(value: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _edges(distance: int) -> list[int]:
    """Where the segments begin and end: so few that of ``distance`` wrong bits one segment has at most one."""
    segments = (distance + 2) // 2
    return [64 * k // segments for k in range(segments + 1)]


def variants(fingerprints: DataFrame, distance: int = 3) -> DataFrame:
    """``fingerprint`` with ``part`` (segment and wiped bit) and ``variant`` (the segment without that bit)."""
    edges = _edges(distance)
    rows = [F.struct(F.lit(low + bit).cast("int").alias("part"),
                     _piece(F.col("fingerprint"), low, high - low).bitwiseAND(F.lit(~(1 << bit)).cast("long")).alias("variant"))
            for low, high in zip(edges, edges[1:]) for bit in range(high - low)]
    return fingerprints.select("fingerprint", F.inline(F.array(*rows)))


def links(fingerprints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs ``low`` < ``high`` of distinct fingerprints that differ in at most ``distance`` bits, each once.

    ``fingerprints`` has the column ``fingerprint`` with distinct values. A
    pair is taken in its first segment that differs in at most one bit; where
    that segment is equal, at the segment's lowest bit.
    """
    # Spark takes the variants to be as few as the fingerprints that they are made from: never a broadcast
    found = variants(fingerprints, distance).hint("merge")
    a, b = found.alias("a"), found.alias("b")
    wrong = F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))
    edges, first = _edges(distance), F.lit(False)
    for low, high in reversed(list(zip(edges, edges[1:]))):
        off = _piece(wrong, low, high - low)
        here = F.col("a.part").between(low, high - 1) & ((off != 0) | (F.col("a.part") == low))
        first = F.when(F.bit_count(off) <= 1, here).otherwise(first)
    return a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.variant") == F.col("b.variant"))
                  & (F.col("a.fingerprint") < F.col("b.fingerprint")) & (F.bit_count(wrong) <= distance) & first
                  ).select(F.col("a.fingerprint").alias("low"), F.col("b.fingerprint").alias("high"))


def _components(of_row: DataFrame, distance: int) -> DataFrame:
    """The rows of ``of_row`` (``id``, ``fingerprint`` and others) with the ``component_id`` of their fingerprint."""
    nodes = stored(of_row.groupBy("fingerprint").agg(F.min("id").alias("first")), "fingerprint-nodes")
    joined = stored(connected(links(nodes.select("fingerprint"), distance)).join(
        nodes.withColumnRenamed("fingerprint", "node"), "node"), "linked")
    names = stored(joined.groupBy("component").agg(F.min("first").alias("name")), "names")
    named = joined.join(names, "component").select(F.col("node").alias("fingerprint"), "name")
    component = stored(nodes.join(named, "fingerprint", "left").select(
        "fingerprint", F.coalesce("name", "first").alias("component_id")), "components")
    return of_row.join(component, "fingerprint")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable over links) of every row."""
    of_row = stored(fingerprints(docs, shingle, id_col, text_col).toDF("id", "fingerprint"), "fingerprints")
    return _components(of_row, distance).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, of each component only the document with the smallest id.

    Rows of one id are judged each by its own text: a row goes only where its
    component has a smaller id. Rows that repeat the smallest id within one
    component are one document and stay together; rows with a null id all stay.
    """
    digest = F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    of_row = stored(fingerprints(docs, shingle, id_col, text_col, digest.alias("digest")).toDF("id", "fingerprint", "digest"),
                    "fingerprints")
    gone = stored(_components(of_row, distance).where("id != component_id").select("id", "digest").distinct(), "duplicates")
    # texts meet what goes in one sorted exchange at every size, however few rows go
    return docs.join(gone.hint("merge"), (docs[id_col] == gone["id"]) & (digest == gone["digest"]), "left_anti").select(docs.columns)
