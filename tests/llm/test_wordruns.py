"""Runs of repeated words against all periods tried at all places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from crawlwright.llm import queries, wordruns

FOLDER = "/root/testdata/sf0.001"


def brute(words, exponent=4, least=6):
    found = set()
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            stretch = words[i:j + p]
            if j > i and len(stretch) >= max(least, exponent * p) and not any(
                    stretch[q:] == stretch[:-q] for q in range(1, p)):
                found.add((i, len(stretch), p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def row_of(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *(best[:1] + best[1:] + (1000 * best[1] // best[2],) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(row_of(r.doc_id, r.text) for r in rows if len(r.text or "") < 8_000)
    ids = {r[0] for r in want}
    got = sorted(tuple(r) for r in queries.op11_word_runs(spark, FOLDER).collect())
    assert len(got) == len(rows) and [r for r in got if r[0] in ids] == want
    assert sum(r[1] > 0 for r in got) >= 5


def test_small_alphabets():
    rng = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
            if words and rng.random() < 0.5:
                a = rng.randrange(len(words))
                p = 1 + (len(words) - a) // rng.randint(3, 10)
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
            texts.append(" ".join(words).encode())
        for exponent, least in ((4, 6), (2, 2)):
            for text, (runs, rest) in zip(texts, wordruns.judged(texts, exponent, least)):
                words = text.decode().split()
                assert runs == brute(words, exponent, least)
                assert rest.decode() == collapsed(words, runs)


@pytest.mark.parametrize("lookups", [1, 7, 1 << 20])
def test_blocks_of_lookups(monkeypatch, lookups):
    """Neither the number of suffixes looked up together nor that of texts sorted together changes a run."""
    monkeypatch.setattr(wordruns, "LOOKUPS", lookups)
    monkeypatch.setattr(wordruns, "RUN_WORDS", lookups)
    texts = [b"x a b a b a b a b y", b"", b"q " * 50, b"a b a b a b a b"]
    assert [r for r, _ in wordruns.judged(texts, 4, 6)] == [[(1, 8, 2)], [], [(0, 50, 1)], [(0, 8, 2)]]


def test_suffix_array():
    t = np.array([1, 2, 1, 2, 1, 3, 1, 2, 4])
    order, inverse, levels = wordruns.suffix_array(t)
    assert sorted(range(len(t)), key=lambda i: t[i:].tolist()) == order.tolist() and (order[inverse] == np.arange(len(t))).all()
    assert wordruns.common(levels, np.array([0, 0, 1]), np.array([2, 6, 7])).tolist() == [3, 2, 1]
    assert wordruns.common(levels, np.array([2, 5]), np.array([4, 8]), back=True).tolist() == [2, 0]


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "b c b c b c b c"),
            (6, "A a A a A a"), (7, "w\xa0v w\xa0v w\xa0v w\xa0v w\xa0v w\xa0v"), (8, "z " * 200_000), (9, "é\x1cx " * 7)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, collapsed int")
    got = wordruns.repeated(docs)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    found = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=lambda r: r[0])
    assert found == [
        (0, [(0, 8, 2)], "b c"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [], "a a a a a"), (5, [(0, 6, 1)], "a"),
        (5, [(0, 6, 1)], "a"), (6, [], "A a A a A a"), (7, [(0, 6, 1)], "w\xa0v"), (8, [(0, 200_000, 1)], "z"),
        (9, [(0, 7, 1)], "é\x1cx")]
    assert wordruns.repeated(docs.limit(0)).count() == 0
