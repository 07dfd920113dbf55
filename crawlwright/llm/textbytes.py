"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

Work goes over runs of whole texts of a few megabytes, so memory follows that
size or one text, whichever is larger, and not the batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on together.
RUN_BYTES = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def runs(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` bytes together, one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text numbers) of the longest spans whose bytes are all marked in ``inside`` (256 flags)."""
    mask = inside[data]
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.zeros(len(mask) + 1, dtype=bool)
    edges[offsets] = True
    before = np.concatenate(([False], mask[:-1]))
    after = np.concatenate((mask[1:], [False]))
    starts = np.flatnonzero(mask & (~before | edges[:-1]))
    ends = np.flatnonzero(mask & (~after | edges[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)
    return series(_BASE), series(pow(_BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    out = np.zeros(len(starts), dtype=np.uint64)
    size = RUN_BYTES + LONG_WORD
    powers, inverse = _powers(size + 1)
    lengths = ends - starts
    first, n = 0, len(starts)
    while first < n:
        if lengths[first] > LONG_WORD:
            out[first] = xxhash.xxh64_intdigest(data[starts[first]:ends[first]].tobytes())
            first += 1
            continue
        last = int(np.searchsorted(starts, starts[first] + RUN_BYTES, side="left"))
        too_long = np.flatnonzero(lengths[first:last] > LONG_WORD)
        last = first + int(too_long[0]) if len(too_long) else last
        low = starts[first]
        part = data[low:ends[last - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * powers[:len(part)], dtype=np.uint64)))
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        first = last
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive word hashes; texts are not told apart."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + words[k:len(words) - n + 1 + k]
    return mixed(total)
