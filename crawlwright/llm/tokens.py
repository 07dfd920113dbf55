"""Token ids of many texts at once with a public byte-level BPE tokenizer.

Tokenizers of this family cut a text into pre-tokens: letters, digits or other
signs, each with a blank before it, and white space. So a new pre-token always
begins at a blank or line feed after a character that is not white space, at a
stop or comma after a letter, and at a letter after a line feed that ends such
a piece. Texts may be cut there and the pieces encoded one by one. A piece
mostly repeats one seen before. Pieces of up to 16 bytes are grouped by a hash
and each is compared with its group's sample, all its bytes and its length;
those that differ, and longer pieces, stand for themselves. A sample is looked
up in a table that the worker keeps: arrays in order of the hash that hold all
bytes and the length, which must be the same. What stands for itself is looked
up by its bytes in a smaller dictionary. Only new pieces go through the
tokenizer.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa

from . import textbytes

#: Pieces that a worker remembers in arrays (some 40 bytes and the ids each) and in a dictionary (some 200 bytes each);
#: both start anew when one is full.
MEMORY, OTHERS = 1_200_000, 200_000
#: Bytes of text whose pieces are looked up together.
RUN_BYTES = 2 << 20
#: Bytes of the longest piece that is remembered.
_LONGEST = 64
_GRAPHIC = np.zeros(256, dtype=bool)
_GRAPHIC[0x21:0x7F] = True
_CUT = np.zeros(256, dtype=bool)
_CUT[[0x0A, 0x20]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b",.!?;:")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_WORKERS: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer with the pieces it has met."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores belong to its tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        # hash, first and last eight bytes, length and place of each piece in order of the hash; the first entry is no piece
        self.known = [np.zeros(1, kind) for kind in (np.uint64, np.uint64, np.uint64, np.uint8, np.int64)]
        self.others: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _encode(self, pieces: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of pieces, in parts, and how many each has."""
        parts, sizes = [], []
        for first in range(0, len(pieces), 2000):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(
                [p.decode() for p in pieces[first:first + 2000]], add_special_tokens=False)]
            parts.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32))
            sizes.extend(map(len, found))
        return parts, np.array(sizes, np.int64)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The places of new pieces: the first of their ids in the table, shifted, and how many they have."""
        parts, sizes = self._encode(pieces)
        places = (self.used + np.cumsum(sizes) - sizes) << 16 | sizes
        used = self.used + int(sizes.sum())
        if used > len(self.ids):
            grown = np.zeros(2 * used, np.uint32)
            grown[:self.used] = self.ids[:self.used]
            self.ids = grown
        self.ids[self.used:used] = np.concatenate((np.zeros(0, np.uint32), *parts))
        self.used = used
        return places

    def _remember(self, *columns: np.ndarray) -> None:
        """Pieces whose hashes are new and in order become known."""
        at = np.searchsorted(self.known[0], columns[0]) + np.arange(len(columns[0]))
        old = np.ones(len(self.known[0]) + len(at), dtype=bool)
        old[at] = False
        for k, column in enumerate(columns):
            grown = np.empty(len(old), self.known[k].dtype)
            grown[old], grown[at] = self.known[k], column
            self.known[k] = grown

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, first id of each text and the end) of a run of texts given as bytes and offsets."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        before = np.concatenate(([np.uint8(0)], data[:-1]))
        solid, letter = _GRAPHIC[before], _LETTER[before]
        # Latin letters of two bytes, but not the two signs among them; other scripts are cut at ASCII neighbours only
        latin = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        solid[2:] |= latin
        letter[2:] |= latin
        cut = (_CUT[data] & solid) | (_STOP[data] & letter)
        cut[1:] |= _LETTER[data[1:]] & (data[:-1] == 0x0A) & solid[:-1]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        if len(self.known[0]) > MEMORY or len(self.others) > OTHERS:
            self._forget()
        raw, length = data.tobytes(), ends - starts
        words = np.lib.stride_tricks.as_strided(np.append(data, np.zeros(16, np.uint8)).view(), (len(data) + 9, 8), (1, 1)).view("<u8")[:, 0]
        low = words[starts] & _FIRST[np.minimum(length, 8)]
        high = words[starts + 8 * (length > 8)] & _FIRST[np.clip(length - 8, 0, 8)]
        short = np.flatnonzero(length <= 16)
        mixed = textbytes.mixed(low[short] + textbytes.mixed(high[short] + length[short].astype(np.uint64)))
        hashes, sample, which = np.unique(mixed, return_index=True, return_inverse=True)
        sample = short[sample]
        same = sample[which]
        sure = (low[short] == low[same]) & (high[short] == high[same]) & (length[short] == length[same])
        del mixed, same
        keys = (hashes, low[sample], high[sample], length[sample])
        del low, high

        def cut_out(asked: np.ndarray) -> list[bytes]:
            return [raw[s:e] for s, e in zip(starts[asked].tolist(), ends[asked].tolist())]
        at = np.minimum(np.searchsorted(self.known[0], hashes), len(self.known[0]) - 1)
        taken, *equal = (column[at] == key for column, key in zip(self.known, keys))
        place = self.known[-1][at]
        new = np.flatnonzero(~taken)
        if len(new):
            place[new] = self._learn(cut_out(sample[new]))
            self._remember(*(key[new] for key in keys), place[new])
        odd = np.flatnonzero(taken & ~np.logical_and.reduce(equal))  # the hash is known by another piece
        alone = np.concatenate((sample[odd], short[~sure], np.flatnonzero(length > 16)))
        pieces = cut_out(alone)
        found = np.fromiter(map(self.others.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0).tolist()
        unknown = dict.fromkeys(pieces[k] for k in missing)
        kept = [p for p in unknown if len(p) <= _LONGEST]
        self.others.update(zip(kept, self._learn(kept).tolist()))
        found[missing] = [self.others.get(pieces[k], 0) for k in missing]
        place[odd] = found[:len(odd)]
        places = np.zeros(len(starts), np.int64)
        places[short] = place[which]
        places[alone[len(odd):]] = found[len(odd):]
        del short, which, sure
        first, size = places >> 16, places & 0xFFFF
        table, long = self.ids, [p for p in unknown if len(p) > _LONGEST]
        if long:
            own, counts = self._encode(long)
            table = np.concatenate((self.ids[:self.used], *own))
            begins = self.used + np.cumsum(counts) - counts
            row = {p: k for k, p in enumerate(long)}
            at = np.array([len(p) > _LONGEST for p in pieces])
            rest = [row[p] for p in pieces if len(p) > _LONGEST]
            first[alone[at]], size[alone[at]] = begins[rest], counts[rest]
        ends_of = np.cumsum(size)
        at = np.repeat(first - (ends_of - size), size) + np.arange(ends_of[-1])
        total = np.concatenate(([0], ends_of))
        return table[at], total[np.searchsorted(starts, offsets, side="left")]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it stays for the tasks that follow."""
    if path not in _WORKERS:
        _WORKERS[path] = Encoder(path)
    return _WORKERS[path]


def encoded(column: pa.Array, path: str, end: int | None = None):
    """The ids (uint32) of each text, in order, with ``end`` after them if given; null is an empty text."""
    data, offsets = textbytes.bytes_of(column)
    tokenizer = encoder(path)
    for first, last in textbytes.runs(offsets, RUN_BYTES):
        ids, bounds = tokenizer.run(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[a:b] if end is None else np.append(ids[a:b], np.uint32(end))
