"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text and normalised by length.

Folding undoes disguise: compatibility forms and accents become base letters,
look-alikes of other scripts and digits become the letter they stand for,
invisible characters go, and everything that is no letter parts words.

The lexicon is learned from labelled rows: words and beginnings of words whose
documents are toxic far more often than others (log-likelihood ratio), seen in
at least two contexts so that copies of one text prove nothing; an entry's
weight is a lower bound of its log-odds. A logistic model over the matched weight and
the matched weight per word turns this into a score; it is fitted on labelled
rows that the lexicon did not see. Where a phrase of ``exceptions`` covers a
match, the match does not count.

Training reads at most ``max_labelled`` labelled rows, those with the smallest
hash of their id, whatever the size of the table; the lexicon has at most
``max_entries`` entries. Both are collected and broadcast under these bounds.
Scoring is one pass over the texts without a shuffle.

Edge cases: a null, empty or wordless text has the score of no match; labels
that are null, or of a null id, are ignored; a document labelled twice counts
as toxic if one label says so; repeated rows are each scored. Without a toxic
and a clean label every score is 0. Other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LABELLED = 20_000
MAX_ENTRIES = 5_000
#: Twice the log-likelihood ratio that an entry needs.
LEAST_RATIO = 25.0
#: The log-odds that an entry has, or more, with few chances against it.
LEAST_WEIGHT = 2.5
_DEVIATIONS = 1.64
THRESHOLD = 0.3
_SHORTEST, _LONGEST = 4, 12
#: Words that are added to every length, so that one match in a short text is not certainty.
_SMOOTH = 20

# Characters that look like a Latin letter, and digits and signs written for one.
LOOK_ALIKES = {
    "a": "аα4@", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еεэ3", "g": "ɡ9", "h": "һн", "i": "іıιl1|", "j": "јϳ", "k": "кκ",
    "m": "м", "n": "пη", "o": "оοσ0", "p": "рρ", "q": "ԛ", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ԝω",
    "x": "хχ", "y": "уγ", "z": "ʐ2",
}
#: Harmless phrases that hold a word of abuse.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "pond scum", "sore loser")


class _Fold(dict):
    """The folded form of a character, worked out when it is first seen."""

    def __init__(self) -> None:
        super().__init__()
        for letter, others in LOOK_ALIKES.items():
            for other in others:
                self[ord(other)] = letter

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            known = self[ord(c)] if ord(c) != code and dict.__contains__(self, ord(c)) else c
            if known.isalpha():
                out += known
            elif unicodedata.category(c) not in ("Mn", "Cf"):
                out += " "
        self[code] = out
        return out


_FOLD = _Fold()


def folded(text: str | None) -> list[str]:
    """The folded words of a text."""
    return (text or "").lower().translate(_FOLD).split()


@dataclass(frozen=True)
class Model:
    """What scoring needs: entries with weights (a blank before, and after if the whole word), and the logistic model."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    intercept: float
    slopes: tuple[float, float]

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, weight in self.entries:
            out.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            phrase = f" {' '.join(folded(phrase))} "
            out.add_word(phrase, (len(phrase), None))
        if len(out):
            out.make_automaton()
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + features @ np.array(self.slopes), -30, 30)))


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """(logarithm of the matched weight, matched weight per 100 words)."""
    words = folded(text)
    if not words or not len(automaton):
        return 0.0, 0.0
    best: dict[int, float] = {}
    harmless: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if weight is None:
            harmless.append((start, end))
        else:
            best[start] = max(weight, best.get(start, 0.0))
    if harmless:
        merged: list[list[int]] = []
        for start, end in sorted(harmless):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        begins = [start for start, _ in merged]
        best = {at: w for at, w in best.items() if at < begins[0] or at >= merged[bisect.bisect_right(begins, at) - 1][1]}
    total = sum(best.values())
    return math.log1p(total), 100 * total / (len(words) + _SMOOTH)


def remainder(id_col: str = "doc_id") -> Column:
    """The fourth of the rows that an id belongs to; a null id is in none."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)), F.lit(-1)).cast("int")


def _word_counts(rows: DataFrame) -> DataFrame:
    """Toxic and clean rows per folded word, with the least and the greatest hash of its contexts."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            around: dict[str, tuple[int, int]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = folded(text.as_py())
                counts[toxic].update(set(words))
                if toxic:
                    for a, w, b in zip(["", *words], words, [*words[1:], ""]):
                        h = zlib.crc32(f"{a} {b}".encode())
                        low, high = around.get(w, (h, h))
                        around[w] = min(low, h), max(high, h)
            for first in range(0, len(words := list(counts[1])), 50_000):
                part = words[first:first + 50_000]
                yield _counts_batch(part, counts, around)
            for first in range(0, len(words := [w for w in counts[0] if w not in counts[1]]), 50_000):
                yield _counts_batch(words[first:first + 50_000], counts, around)
    found = rows.select("text", "toxic").mapInArrow(scan, "word string, toxic long, clean long, low long, high long")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
                                     F.min("low").alias("low"), F.max("high").alias("high"))


def _counts_batch(words: list[str], counts: tuple[Counter, Counter], around: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()),
        pa.array([counts[0][w] for w in words], pa.int64()),
        pa.array([around[w][0] if w in around else None for w in words], pa.int64()),
        pa.array([around[w][1] if w in around else None for w in words], pa.int64())],
        names=["word", "toxic", "clean", "low", "high"])


def _lexicon(words: DataFrame, toxic: int, clean: int, max_entries: int) -> list[tuple[str, float]]:
    """The entries with the greatest evidence; every whole word and every beginning of words is a candidate."""
    cut = F.transform(F.sequence(F.lit(_SHORTEST), F.least(F.length("word") - 1, F.lit(_LONGEST))),
                      lambda n: F.concat(F.lit(" "), F.substring("word", F.lit(1), n)))
    cut = F.when(F.length("word") > _SHORTEST, cut).otherwise(F.array().cast("array<string>"))
    whole = F.array(F.concat(F.lit(" "), F.col("word"), F.lit(" ")))
    found = words.select(F.explode(F.concat(whole, cut)).alias("entry"), "toxic", "clean", "low", "high").groupBy("entry").agg(
        F.least(F.sum("toxic"), F.lit(toxic)).alias("a"), F.least(F.sum("clean"), F.lit(clean)).alias("b"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    a, b, share = F.col("a"), F.col("b"), toxic / (toxic + clean)

    def part(count: Column, expected: Column) -> Column:
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)
    ratio = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    weight = (F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
              - _DEVIATIONS * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
    rows = found.where(F.col("low") < F.col("high")).select("entry", weight.alias("weight"), ratio.alias("ratio")).where(
        (F.col("weight") > LEAST_WEIGHT) & (F.col("ratio") >= LEAST_RATIO)).orderBy(F.desc("ratio"), "entry").limit(max_entries)
    return [(r.entry, float(r.weight)) for r in rows.collect()]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4) -> tuple[float, tuple[float, float]]:
    """Newton steps for a logistic model with a small ridge penalty."""
    full = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(full.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        hessian = (full * (p * (1 - p))[:, None]).T @ full + penalty * len(x) * np.eye(len(w))
        step = np.linalg.solve(hessian, full.T @ (y - p) - penalty * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), (float(w[1]), float(w[2]))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           exceptions: Sequence[str] = EXCEPTIONS, max_labelled: int = MAX_LABELLED, max_entries: int = MAX_ENTRIES) -> Model:
    """The model from labelled rows, without the fourth that is held out."""
    sample = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
              .where(remainder("id") != 2).groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(max_labelled))  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    learn, rest = rows.where(remainder("id") != 3), rows.where(remainder("id") == 3)
    size = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model((), (), -30.0, (0.0, 0.0))
    entries = tuple(_lexicon(_word_counts(learn), size[1], size[0], max_entries))
    raw = Model(entries, tuple(exceptions), 0.0, (1.0, 1.0))
    found = _features(rest, raw).collect()
    y = np.array([r.toxic for r in found], float)
    if not len(y) or y.min() == y.max():
        return Model(entries, tuple(exceptions), -4.0, (1.0, 0.1))
    return Model(entries, tuple(exceptions), *_logistic(np.array([(r.matched, r.density) for r in found]), y))


def _features(rows: DataFrame, model: Model) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = np.array([features(t.as_py(), automaton) for t in batch.column(0)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])],
                                             names=["toxic", "matched", "density"])
    return rows.select("text", "toxic").mapInArrow(scan, "toxic int, matched double, density double")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([source.schema[0], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _scores(batch.column(1), shared.value, automaton)],
                                             names=schema.names)
    return source.mapInArrow(scan, schema)


def _scores(column: pa.Array, model: Model, automaton: ahocorasick.Automaton) -> pa.Array:
    return pa.array(model.score(np.array([features(t.as_py(), automaton) for t in column]).reshape(-1, 2)), pa.float64())


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, without the rows that score ``threshold`` or more."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            score = np.asarray(_scores(batch.column(at), shared.value, automaton))
            yield batch.filter(pa.array(score < threshold))
    return docs.mapInArrow(scan, docs.schema)
