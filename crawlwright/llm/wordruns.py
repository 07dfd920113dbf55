"""Runs of repeated words, found in an enhanced suffix array of word numbers.

The words of some texts are numbered and laid end to end, each text closed by
a number of its own, so that nothing repeats across texts. A suffix array is
built by doubling prefixes; the ranks of every length are kept, and the common
prefix of any two suffixes is read from them, longest length first.

A boundary between neighbouring suffixes with a common prefix of ``depth``
words splits an LCP interval in two. For each suffix ``i`` of the smaller part,
``ISA[i + depth]`` and ``ISA[i - depth]`` are looked up in the other part: a hit
is a square of period ``depth`` whose next word breaks the period. Intervals
are pairs of numbers from the nearest smaller LCP values; there are no tree
nodes. A square is rotated to the left by common extension, again from the
ranks, which gives its run; squares of one stretch merge, the smallest period
stays.

Everything about one text happens in the task that reads it, in numpy over
about ``RUN_WORDS`` words at once or one text, whichever is larger; nothing is
shuffled.

Edge cases: words are what white space (ASCII) parts, compared byte by byte. A
null text has no words, no runs and an empty collapsed text. Very long texts
are worked on whole; memory follows the longest one, some 300 bytes a word.
Rows that repeat an id each give a row; null ids stay null; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that are sorted together.
RUN_WORDS = 1 << 18
#: Suffixes of smaller parts that are looked up together.
LOOKUPS = 1 << 20
#: A run repeats its period so often at least, and has so many words.
LEAST_EXPONENT, LEAST_WORDS = 4, 6

Levels = list[tuple[int, int, np.ndarray]]


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, all word numbers from 1 with a closing number behind each text, starts of the texts)."""
    number: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.empty(starts[-1], np.int64)
    inside = np.ones(len(out), bool)
    inside[starts[1:] - 1] = False
    out[inside] = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
    out[~inside] = len(number) + 1 + np.arange(len(words))
    return words, out, starts


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, Levels]:
    """(suffix array, its inverse, levels) of numbers of which the last is unlike all others.

    A level is (length, how often it may repeat in a common prefix that the
    level above does not cover, rank): suffixes are equal in the first
    ``length`` numbers if and only if their ranks are.
    """
    n, bits = len(t), int(t.max()).bit_length()
    width = min(max(1, 62 // bits), 8, n)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[:n - k] |= t[k:]
    order = np.argsort(key)
    sorted_keys = key[order]
    first = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels = [(1, width - 1, t.astype(np.int32))] if width > 1 else []
    levels.append((width, 1, rank.astype(np.int32)))
    tied = ~(first & np.append(first[1:], True))
    length = width
    while tied.any():
        slots = np.flatnonzero(tied)
        at = order[slots]
        after = at + length
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key)
        key, at = key[by], at[by]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        order[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        tied[slots] = ~(first & np.append(first[1:], True))
        length *= 2
        levels.append((length, 1, rank.astype(np.int32)))
    return order, rank, levels


def common(levels: Levels, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` share from their starts on, or before them if ``back``."""
    n = len(levels[0][2])
    got = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))

    def step(length: int, rank: np.ndarray, which: np.ndarray) -> np.ndarray:
        x, y = (a[which] - got[which] - length, b[which] - got[which] - length) if back else (a[which] + got[which], b[which] + got[which])
        inside = (x >= 0) & (y >= 0) if back else (x < n) & (y < n)
        same = np.zeros(len(which), bool)
        same[inside] = rank[x[inside]] == rank[y[inside]]
        return which[same]
    short = [v for v in levels if v[0] == 1][:1]
    longer = levels[len(short):]
    for length, _, rank in longer[:1]:
        todo = step(length, rank, todo)
    for length, _, rank in reversed(longer):
        got[step(length, rank, todo)] += length
    for length, times, rank in short:
        todo = np.arange(len(a))
        for _ in range(times):
            todo = step(length, rank, todo)
            got[todo] += length
    return got


def nearest(values: np.ndarray, strict: bool) -> np.ndarray:
    """The last place before each value above 0 whose value is less (``strict``) or at most as great.

    Places jump to the place that their last stop points to, all at once. The first value is below all others.
    """
    place = np.maximum(np.arange(len(values)) - 1, 0)
    todo = np.flatnonzero(values > 0)
    while len(todo):
        stop = values[place[todo]]
        more = stop >= values[todo] if strict else stop > values[todo]
        todo = todo[more]
        place[todo] = place[place[todo]]
    return place


def squares(order: np.ndarray, inverse: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of all squares whose period the next word breaks; one may come twice."""
    n = len(order)
    lcp = np.concatenate(([-1], common(levels, order[:-1], order[1:]), [-1]))
    at = np.flatnonzero(lcp > 0)
    low = nearest(lcp, strict=True)[at]
    high = n - nearest(lcp[::-1], strict=False)[n - at]
    depth = lcp[at]
    left = at - low <= high - at
    small = np.where(left, low, at), np.where(left, at, high)
    other = np.where(left, at, low), np.where(left, high, at)
    total = np.concatenate(([0], np.cumsum(small[1] - small[0])))
    found_at, found_depth = [], []
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + LOOKUPS, side="right")) - 1)
        size = total[begin + 1:end + 1] - total[begin:end]
        which = np.repeat(np.arange(begin, end), size)
        i = order[small[0][which] + np.arange(len(which)) - np.repeat(total[begin:end] - total[begin], size)]
        d, first, last = depth[which], other[0][which], other[1][which]
        for shift in (d, -d):
            x = i + shift
            inside = np.flatnonzero((x >= 0) & (x < n))
            rank = inverse[x[inside]]
            hit = inside[(rank >= first[inside]) & (rank < last[inside])]
            found_at.append(np.minimum(i[hit], x[hit]))
            found_depth.append(d[hit])
        begin = end
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_at or none), np.concatenate(found_depth or none)


def word_runs(t: np.ndarray, exponent: int = LEAST_EXPONENT, words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of the runs in numbers, by start and then period."""
    if not len(t):
        return (np.zeros(0, np.int64),) * 3
    order, inverse, levels = suffix_array(t)
    at, period = squares(order, inverse, levels)
    before = common(levels, at, at + period, back=True)
    start, length = at - before, 2 * period + before
    keep = (length >= words) & (length >= exponent * period)
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.ones(len(by), bool)  # of one stretch the smallest period
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in order, about RUN_WORDS words together (a word and its blank are two bytes at least)."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) // 6 + 2
        if size >= RUN_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def judged(texts: list[bytes], exponent: int, least: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """(runs, text without repeats) of each text."""
    for group in _groups(texts):
        words, numbers, starts = numbered(group)
        start, length, period = word_runs(numbers, exponent, least)
        text = np.searchsorted(starts, start, side="right") - 1
        bounds = np.searchsorted(text, np.arange(len(group) + 1))
        dropped = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(dropped, start + period, 1)
        np.add.at(dropped, start + length, -1)
        kept = np.cumsum(dropped[:-1]) == 0
        for k, own in enumerate(words):
            a, b = bounds[k], bounds[k + 1]
            runs = list(zip((start[a:b] - starts[k]).tolist(), length[a:b].tolist(), period[a:b].tolist()))
            if runs:
                own = list(itertools.compress(own, kept[starts[k]:starts[k] + len(own)].tolist()))
            yield runs, b" ".join(own)


def repeated(docs: DataFrame, exponent: int = LEAST_EXPONENT, words: int = LEAST_WORDS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The runs of repeated words of every text, and the text without their repeats.

    A run is a longest stretch of words with smallest period ``period`` that
    has at least ``exponent`` periods and ``words`` words. Returns ``id_col``,
    ``runs`` (array of ``start`` in words from 0, ``length``, ``period``; by start, then
    period) and ``collapsed``: the words that no run contains after its first
    period, joined by one blank.
    """
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    names = ["start", "length", "period"]
    schema = T.StructType([
        source.schema[0],
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in names]))),
        T.StructField("collapsed", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            runs, collapsed = zip(*judged(texts, exponent, words)) if texts else ((), ())
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in runs]))).astype(np.int32)
            flat = np.array([x for y in runs for x in y], dtype=np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), items),
                pa.array(collapsed, pa.binary()).cast(pa.string())], names=[f.name for f in schema.fields])
    return source.mapInArrow(scan, schema)
