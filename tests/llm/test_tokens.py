"""Token ids, token files and packing against the tokenizer itself."""

import gc
import itertools
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from crawlwright.llm import packing, queries, tokenfiles, tokens

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  x", "a  b", "a \n b\n\nc", "don't I'll", "é à b ", "a  b", "a　 b c", "a\xa0 b", "x<|endoftext|> y <|endoftext|>",
       "<|endoftext|>", "a\tb \tc\r\n d", "日本 語 の。x", "1 2 34 a1 b", "z" * 200 + " " + "q" * 100, "\x1c a\x1c b", "ÃÂ Ã b× c÷ d",
       "é f", "x.\nYo\n\nZ\n a", "a÷,b×. c", "é,è.x", "a\n", "\na", "a:b;c!?d", "x\r\ny. \nZ", "l'été, c'est", "á, b", "\U0001f600 x"]


TOKENIZER = Tokenizer.from_file(PATH)


def plain(text, end):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoded():
    texts = ODD + ["".join(p) for p in itertools.product([" ", "\n", "a", "é", ".", "'s", "7"], repeat=4)]
    for text, ids in zip(texts, tokens.encoded(pa.array(texts), PATH)):
        assert TOKENIZER.encode(text, add_special_tokens=False).ids == ids.tolist(), text


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


def test_like_hashes(monkeypatch):
    """Pieces that a weak hash takes for one another, as it does any pair here, keep their own ids."""
    texts = [thue_morse(n, *pair) for n in (4, 8, 16, 64, 1024, 2048, 4096, 8192) for pair in ("ab", "ba")]
    texts += [" ".join(texts), "the cat sat on the mat " * 50 + "a" * 16 + " " + "a" * 17]

    def check():
        for text, ids in zip(texts, tokens.encoded(pa.array(texts), PATH)):
            assert TOKENIZER.encode(text, add_special_tokens=False).ids == ids.tolist(), text[:50]
    check()
    monkeypatch.setattr(tokens.textbytes, "mixed", lambda h: h * np.uint64(0))
    check()


def test_known_pieces(monkeypatch):
    """Pieces met in earlier runs keep their own ids, also where another has their hash or a table is full and starts anew."""
    texts = ["".join(f" {a}{b}{k}" for a in ("x", "ab", "é") for b in ("", "c" * 14, "d" * 30)) for k in range(60)] * 3
    want = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    for values, memory, others in ((1 << 64, 1 << 20, 1 << 20), (8, 1 << 20, 1 << 20), (64, 5, 1 << 20), (1 << 64, 1 << 20, 5)):
        monkeypatch.setattr(tokens.textbytes, "mixed", lambda h: h & np.uint64(values - 1))
        monkeypatch.setattr(tokens, "RUN_BYTES", 500)
        monkeypatch.setattr(tokens, "MEMORY", memory)
        monkeypatch.setattr(tokens, "OTHERS", others, raising=False)
        monkeypatch.setattr(tokens, "_WORKERS", {})
        assert [x.tolist() for x in tokens.encoded(pa.array(texts), PATH)] == want


def test_memory_of_known_pieces():
    """The worker's table takes little more than the pieces' bytes and ids, and a run of text a few times its bytes."""
    encoder = tokens.Encoder(PATH)
    gc.collect()
    tracemalloc.start()
    for first in range(0, 240_000, 60_000):
        data = "".join(f" w{k * 7919 % 1_000_003}" for k in range(first, first + 60_000)).encode() * 4
        encoder.run(np.frombuffer(data[:tokens.RUN_BYTES], np.uint8), np.array([0, min(len(data), tokens.RUN_BYTES)]))
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 240_000 * 100
    assert most - kept < 60e6


@pytest.mark.parametrize("bits", [3, 8, 15, 16, 17])
def test_bits(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 10_000).astype(np.uint32)
    payload, offsets = tokenfiles.packed(ids, bits)
    assert len(payload) == sum((min(4096, 10_000 - k) * bits + 7) // 8 for k in range(0, 10_000, 4096))
    assert (tokenfiles.unpacked(payload, offsets, bits, len(ids)) == ids).all()
    assert (tokenfiles.unpacked(payload, offsets, bits, len(ids), 5000, 4000) == ids[5000:9000]).all()
    with pytest.raises(ValueError):
        tokenfiles.packed(np.array([1 << bits], np.uint32), bits)


def test_files_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for r in rows:
        ids = plain(r.text, 2)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, queries.op9_token_files(spark, FOLDER).collect())) == want


CASES = [(2, "b"), (None, "null id"), (1, None), (3, ""), (2, "a"), (7, "word " * 60_000), (2, "a")] + [(10 + i, t) for i, t in enumerate(ODD)] + [
    (100, thue_morse(1024)), (101, thue_morse(1024, "b", "a"))]


def test_files_cases(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 1) for i, t in CASES], "doc_id long, text string, shard int")
    tokenfiles.write(docs, f"{tmp_path}/a", PATH, 2)
    got = sorted(((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in tokenfiles.read(spark, f"{tmp_path}/a").collect()))
    want, start = [], 0
    for i, t in sorted(CASES, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = plain(t, 2)
        want.append((start, i, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    tokenfiles.write(docs.limit(0), f"{tmp_path}/b", PATH, 2)
    assert tokenfiles.read(spark, f"{tmp_path}/b").count() == 0


def whole(pieces, docs, length=1024):
    """Every id of every document in one piece, every sequence gapless and full, or a power of two."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc_id, text in docs:
        own, ids = sorted(by_doc.pop(doc_id), key=lambda p: p.start), plain(text, 0)
        assert [p.start for p in own] == [0, *itertools.accumulate(p.length for p in own)][:-1]
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        yield own, ids
    assert not by_doc
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        ends = [0, *itertools.accumulate(p.length for p in own)]
        assert [p.offset for p in own] == ends[:-1] and (ends[-1] == length or ends[-1] in {1 << b for b in range(10)})


def test_packing_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    for own, ids in whole(queries.op10_packing(spark, FOLDER).collect(), docs):
        assert all(p.ids_crc32 == crc(ids[p.start:p.start + p.length]) for p in own)


def test_packing_cases(spark):
    rows = [(1, None), (3, ""), (None, "null id"), (7, "word " * 300_000)] + [(10 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    for own, ids in whole(packing.packed(docs, PATH, 0).collect(), rows):
        assert b"".join(bytes(p.ids) for p in own) == np.array(ids, "<u4").tobytes()
    assert packing.packed(docs.limit(0), PATH, 0).count() == 0
    twice = packing.packed(docs.unionAll(docs), PATH, 0).collect()
    assert sum(p.length for p in twice) == 2 * sum(len(plain(t, 0)) for _, t in rows)


def test_hilbert():
    for n, bits in ((2, 4), (3, 3)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = packing.hilbert(points, bits)
        assert sorted(keys.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours():
    rng = np.random.default_rng(2)
    topics = [rng.integers(0, 50_000, 40) for _ in range(12)]
    documents = [rng.choice(topics[k % 12], 300) for k in range(240)]
    order = np.argsort(packing.curve_keys(documents), kind="stable") % 12
    assert (order[1:] == order[:-1]).mean() > 0.5


def test_pieces_in_curve_order(spark):
    """Documents follow one another in the order of the keys, over all sequences."""
    rng = np.random.default_rng(3)
    docs = [(k, " ".join(rng.choice(["red", "green", "blue", "old", "new"], rng.integers(1, 200)))) for k in range(60)]
    pieces = packing.packed(spark.createDataFrame(docs, "doc_id long, text string"), PATH, 0).collect()
    order = list(dict.fromkeys(p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))))
    keys = packing.curve_keys([np.array(plain(t, 0)) for _, t in docs])
    assert order == sorted(range(60), key=lambda k: (keys[k], k))
