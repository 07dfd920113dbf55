"""Stupid backoff against plain dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from crawlwright.llm import lmscore, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, order=2, backoff=0.4):
    texts = [tuple(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for _, t in rows]

    def grams(w):
        return Counter(w[i:i + n] for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total, size = sum((grams(w) for w in texts), Counter()), sum(map(len, texts))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        own, score = grams(w), 0.0
        for i in range(len(w)):
            top = min(order, i + 1)
            for n in range(top, 0, -1):
                gram = w[i - n + 1:i + 1]
                c = total[gram] - own[gram]
                if n == 1:
                    score += math.log(max(c, 0.5) / max(size - len(w), 1) * backoff ** (top - 1))
                elif c > 0:
                    score += math.log(c / (total[gram[:-1]] - own[gram[:-1]]) * backoff ** (top - n))
                    break
        out.append((doc_id, len(w), score))
    return sorted(out, key=repr)


def same(found, rows, order=2):
    got, want = sorted(((r.doc_id, r.n_words, r.log_score) for r in found.collect()), key=repr), brute(rows, order)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.op7_stupid_backoff(spark, FOLDER), rows)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_cases(spark, monkeypatch, order):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 40)
    monkeypatch.setattr(lmscore, "BLOCK_ROWS", 2)
    monkeypatch.setattr(lmscore, "BUCKET_GRAMS", 7)
    rows = [(1, None), (2, ""), (3, "a b c a b"), (4, "A b d"), (5, "x"), (6, "é b c d " * 2000), (None, "b c"), (8, "-- !"), (7, "a b c a b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    same(lmscore.scored(docs, order), rows, order)
    assert lmscore.scored(docs.limit(0)).count() == 0
    same(lmscore.scored(docs.where("doc_id = 3")), rows[2:3])


def test_answers():
    """Whatever batches and buckets the rows come in, a block's totals come back in the order of its hashes."""
    rng = np.random.default_rng(7)
    rows = sorted({(int(g) >> 61, int(b), int(n), int(g)) for g, b, n in zip(
        rng.integers(0, 1 << 64, 600, dtype=np.uint64), rng.integers(0, 4, 600), rng.integers(1, 3, 600))},
        key=lambda r: (r[0], r[2], np.uint64(r[3]).astype(np.int64)))
    table = pa.table({"bucket": [r[0] for r in rows], "block": [r[1] for r in rows], "length": pa.array([r[2] for r in rows], pa.int32()),
                      "gram": np.array([r[3] for r in rows], np.uint64).view(np.int64), "total": [r[3] % 1000 for r in rows]})
    for size, least in ((1, 1), (7, 20), (50, 100), (1000, 1)):
        found = pa.Table.from_batches(lmscore._answers(iter(table.to_batches(size)), least)).sort_by("bucket").to_pylist()
        assert size > 50 or len({r["bucket"] for r in found}) > 1
        for block in range(4):
            for n in (1, 2):
                parts = [lmscore._unpack(r["totals"], np.int64) for r in found if (r["block"], r["length"]) == (block, n)]
                assert np.concatenate(parts).tolist() == [g % 1000 for g in sorted(r[3] for r in rows if r[1:3] == (block, n))]


def test_parts(monkeypatch):
    """Texts of a block score alike in parts of any size, empty texts and one longer than a part among them."""
    rng = np.random.default_rng(11)
    sizes = np.array([0, 5, 0, 400, 1, 30, 0])
    block = lmscore._Block(sizes, rng.integers(1, 9, sizes.sum()).astype(np.uint64))
    totals = [np.unique(block.grams(n)[1], return_counts=True)[1] + 1 for n in (1, 2, 3)]
    whole = block.scores(totals, 1000, 0.4)
    for size in (1, 6, 100):
        monkeypatch.setattr(lmscore, "PART_WORDS", size)
        assert block.scores(totals, 1000, 0.4).tolist() == pytest.approx(whole.tolist())
    with pytest.raises(ValueError, match="totals for"):
        block.scores([t[:-1] for t in totals], 1000, 0.4)
