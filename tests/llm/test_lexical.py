"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from crawlwright.llm import lexical, queries

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(lexical.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=50):
    """(item, rank, doc, score) from lists of (id, text)."""
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words_of(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m))
                        for w in terms if c[w])
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:best])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_query(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{FOLDER}/{t}.parquet").select(i, "text").collect()]
                   for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = queries.op12_lexical_search(spark, FOLDER)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["rank"].dataType.simpleString() == "int"
    assert order(map(tuple, got.collect())) == order(brute(docs, items))


@pytest.mark.parametrize("segment_bytes, items_each, block", [(1, 1, 128), (2_000, 3, 4), (1 << 30, 100, 1)])
def test_segments_and_blocks(spark, monkeypatch, segment_bytes, items_each, block):
    """Whatever the segments, blocks of postings and blocks of items are, the same documents win."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = random.Random(block)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(words[min(39, int(rng.expovariate(0.15)))] for _ in range(rng.randint(0, 30)))) for k in range(250)]
    items = [(k, " ".join(rng.sample(words, rng.randint(1, 12)))) for k in range(12)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = lexical.ranked(frame, asked, best=7, segment_bytes=segment_bytes, items_each=items_each)
    if block == 128:
        assert order(map(tuple, got.collect())) == order(brute(docs, items, 7))
    else:  # the workers do not see the patched size, so search here
        index = lexical.segment_rows(0, [i for i, _ in docs], [t.encode() for _, t in docs], sum(1 for _, t in docs if t),
                                     sum(len(t.split()) for _, t in docs)).to_pylist()
        for item, text in items:
            assert search(index, docs, text, 7)[0] == [(d, s) for _, _, d, s in brute(docs, [(item, text)], 7)]


def search(index, docs, text, best):
    """([(id, score)], lists) of one segment."""
    rows = {r["term"]: r for r in index}
    n = lexical._values(rows[""]["counts"]).astype(np.int64)
    ids = lexical._values(rows[""]["gaps"]).view(np.int64)
    total = int((n > 0).sum())
    m = lexical.lengths_over_mean(n, total, int(n.sum()))
    lists = []
    for w in set(words_of(text)) & set(rows):
        r = rows[w]
        lists.append((math.floor(1000 * math.log((2 * total + 2) / (2 * r["df"] + 1))),
                      lexical.Postings(r["gaps"], r["counts"], r["last"], r["top"], m)))
    at, score = lexical.search(lists, len(n), best)
    return list(zip(ids[at].tolist(), score.tolist())), [p for _, p in lists]


def test_blocks_are_left_out():
    """Rare words fill the threshold; most blocks of a common word are never decoded, and nothing is lost."""
    docs = [(k, "common " + ("rare odd strange" if k % 997 == 5 else f"filler{k % 7}")) for k in range(6_000)]
    index = lexical.segment_rows(0, [i for i, _ in docs], [t.encode() for _, t in docs], 6_000, sum(len(t.split()) for _, t in docs)).to_pylist()
    found, lists = search(index, docs, "common rare odd strange", 5)
    assert found == [(d, s) for _, _, d, s in brute(docs, [(1, "common rare odd strange")], 5)]
    common = max(lists, key=lambda p: len(p.docs))
    assert len(common.last) == 47 and common.decoded.sum() <= 7


def test_cases(spark):
    docs = [(3, None), (4, ""), (5, " ,;"), (1, "One two"), (1, "one TWO"), (None, "one two"), (2, "two two"), (7, "É1 é1 x_y"),
            (9, "long " * 200_000), (8, "one-two")]
    items = [(1, "one"), (1, "two"), (2, None), (3, ""), (None, "É1"), (4, "long X"), (5, "nothing"), (6, "one one two")]
    frame = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, rank int, term string, score string")
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, segment int")
    got = lexical.ranked(frame, asked)
    assert order(map(tuple, got.collect())) == order(brute(docs, items))
    assert lexical.ranked(frame.limit(0), asked).count() == 0
    assert lexical.ranked(frame.where("doc_id = 4"), asked).count() == 0
    assert lexical.ranked(frame, asked.limit(0)).count() == 0
