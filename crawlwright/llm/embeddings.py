"""Embedding near-duplicates with an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted on their own
by k-means on a bounded sample; pairs of codewords are the cells of a product
grid. Every vector is filed in one cell. As a query it visits cells in the
order of the summed half distances (the multi-sequence order: of the first T
cells, the pair of ranks (a, b) has (a + 1)(b + 1) <= T). T follows a target
recall: sample vectors are turned by exactly the threshold's angle at random,
and T is where that share of them has been met. Vectors of equal label meet in
a join on label and cell, and the cosine in double precision verifies each
pair; a pair that meets twice is taken once.

Equal vectors are one class with a number of copies and never meet each other.

Parameters and bounds: the sample has at most ``SAMPLE_ROWS`` classes and
``SAMPLE_BYTES`` bytes, those with the smallest hash of their id; it is
collected, and the codebooks that come from it are broadcast. The number of
codewords follows the root of the number of classes, up to ``MOST_WORDS``.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without label or id link with nothing and are their own
component; vectors of different lengths link with nothing; rows that repeat id
and vector count as vectors of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .storage import stored

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
MOST_WORDS = 1024
#: Vectors that a cell should hold on average.
CELL_ROWS = 32
TARGET_RECALL = 0.995
#: Visits that are tried first; where they miss the target, four times as many, up to the whole grid.
FIRST_VISITS = 256


@dataclass(frozen=True)
class Index:
    """The codebooks of both halves and the number of cells that a query visits."""

    books: tuple[np.ndarray, np.ndarray]
    visits: int

    def halves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = units.shape[1] // 2
        return _distances(units[:, :cut], self.books[0]), _distances(units[:, cut:], self.books[1])

    def cells(self, units: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        a, b = self.halves(units)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def traversal(self, units: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` cells of each vector in multi-sequence order."""
        (a, b), words = self.halves(units), len(self.books[1])
        first, second = a.argsort(axis=1, kind="stable")[:, :count], b.argsort(axis=1, kind="stable")[:, :count]
        ranks = np.array([(i, j) for i in range(first.shape[1]) for j in range(second.shape[1]) if (i + 1) * (j + 1) <= count])
        rows = np.arange(len(units))[:, None]
        left, right = first[:, ranks[:, 0]], second[:, ranks[:, 1]]
        order = (a[rows, left] + b[rows, right]).argsort(axis=1, kind="stable")[:, :count]
        return left[rows, order] * words + right[rows, order]


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)[None, :]


def _book(x: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
    """k-means on ``x``; a word that loses all its points stays where it is."""
    book = x[rng.choice(len(x), min(words, len(x)), replace=False)].copy()
    for _ in range(12):
        nearest = np.concatenate([_distances(x[k:k + 4096], book).argmin(axis=1) for k in range(0, len(x), 4096)])
        count = np.bincount(nearest, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, nearest, x)
        book[count > 0] = total[count > 0] / count[count > 0, None]
    return book


def fitted(sample: np.ndarray, words: int, threshold: float, target: float = TARGET_RECALL, seed: int = 11) -> Index:
    """The index for unit vectors like those of ``sample``."""
    rng, cut = np.random.default_rng(seed), sample.shape[1] // 2
    raw = Index((_book(sample[:, :cut], words, rng), _book(sample[:, cut:], words, rng)), 0)
    probe = sample[rng.choice(len(sample), min(len(sample), 4000), replace=False)]
    side = rng.normal(size=probe.shape)
    side -= (side * probe).sum(axis=1, keepdims=True) * probe
    size = np.linalg.norm(side, axis=1, keepdims=True)
    turned = threshold * probe + math.sqrt(max(0.0, 1 - threshold * threshold)) * side / np.where(size == 0, 1, size)
    whole, count = len(raw.books[0]) * len(raw.books[1]), FIRST_VISITS
    while True:
        count = min(count, whole)
        met, size = [], _rows_at_once(count, 500)
        for k in range(0, len(probe), size):  # a pair is met from either side
            a, b = probe[k:k + size], turned[k:k + size]
            there = raw.traversal(a, count) == raw.cells(b)[:, None]
            back = raw.traversal(b, count) == raw.cells(a)[:, None]
            met.append(np.minimum(np.where(there.any(axis=1), there.argmax(axis=1), count),
                                  np.where(back.any(axis=1), back.argmax(axis=1), count)))
        needed = np.sort(np.concatenate(met))[min(len(probe) - 1, math.ceil(target * len(probe)) - 1)]
        if needed < count or count == whole:
            return Index(raw.books, int(min(count, needed + 1)))
        count *= 4


def _rows_at_once(visits: int, most: int) -> int:
    """So many vectors that their visits fit in memory together."""
    return max(1, most * FIRST_VISITS // max(FIRST_VISITS, visits))


def _usable(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        vector, lambda x: x != 0)


def _units(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filed(classes: DataFrame, index: Index) -> DataFrame:
    """Each class with its unit vector, its cell and the cells that it visits."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            size = _rows_at_once(own.visits, 1000)
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                units = _units(part.column(2))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(list(units), pa.list_(pa.float64())), pa.array(own.cells(units)),
                    pa.array(list(own.traversal(units, own.visits)), pa.list_(pa.int64()))],
                    names=["label", "rep", "unit", "cell", "visits"])
    kinds = dict(classes.dtypes)
    return classes.select("label", "rep", "vector").mapInArrow(
        scan, f"label {kinds['label']}, rep {kinds['rep']}, unit array<double>, cell long, visits array<long>")


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``low`` < ``high`` of classes (``rep``) of equal ``label`` whose ``vector`` has a cosine of ``threshold`` or more.

    Every pair that is given is right; the index finds all but a few of them.
    """
    found = []
    sizes = classes.groupBy(F.size("vector").alias("dim")).count().collect()  # as many as vectors have lengths
    for dim, n in sizes:
        if dim == 1:  # vectors of one component and one sign are one class, and the two signs link with nothing
            continue
        own = classes.where(F.size("vector") == dim)
        rows = own.select("vector", "rep").orderBy(F.xxhash64("rep"), "rep").limit(
            max(100, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))).toArrow()  # bounded
        words = min(MOST_WORDS, max(1, round(math.sqrt(n / CELL_ROWS))))
        filed = stored(_filed(own, fitted(_units(rows.column(0).combine_chunks()), words, threshold)), "filed")
        p = filed.select("label", "rep", "unit", F.col("cell").alias("home"), F.explode("visits").alias("cell")).alias("p")
        x = filed.alias("x")
        cosine = F.aggregate(F.zip_with("p.unit", "x.unit", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        # from the smaller id, or from the greater where the smaller does not visit its cell
        once = (F.col("p.rep") < F.col("x.rep")) | (
            (F.col("p.rep") > F.col("x.rep")) & ~F.array_contains("x.visits", F.col("p.home")))
        met = p.join(x, (F.col("p.label") == F.col("x.label")) & (F.col("p.cell") == F.col("x.cell")) & once
                     & (cosine >= threshold))
        found.append(met.select(F.least("p.rep", "x.rep").alias("low"), F.greatest("p.rep", "x.rep").alias("high")))
    if not found:
        return classes.select(F.col("rep").alias("low"), F.col("rep").alias("high")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """``id_col``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id in reach) and ``kept`` of every row."""
    vector = F.col(vector_col)
    sign = F.transform(vector, lambda x: F.signum(x)).cast(vectors.schema[vector_col].dataType)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(
        (F.size(vector) == 1) & _usable(vector), sign).otherwise(vector).alias("vector"))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    classes = stored(usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    pairs = stored(links(classes, threshold), "links")
    copies = stored(classes.groupBy("rep").agg(F.sum("copies").alias("copies")), "copies")
    both = pairs.select(F.col("low").alias("rep"), F.col("high").alias("other")).unionAll(pairs.select("high", "low"))
    degree = stored(both.join(copies.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(
        F.sum("copies").alias("linked")), "degrees")
    component = stored(connected(pairs).withColumnRenamed("node", "rep"), "components")
    known = stored(classes.join(degree, "rep", "left").join(component, "rep", "left").select(
        "label", "vector", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component")), "known")
    a, b = rows.alias("a"), known.alias("b")
    joined = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vector") == F.col("b.vector"))
                    & F.col("a.id").isNotNull(), "left")
    top = F.coalesce("b.component", "a.id")
    return joined.select(F.col("a.id").alias(id_col), F.coalesce("b.n_links", F.lit(0)).cast("long").alias("n_links"),
                         top.alias("component_id"), F.coalesce(top == F.col("a.id"), F.lit(True)).alias("kept"))
