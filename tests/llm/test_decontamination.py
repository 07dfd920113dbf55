"""Decontamination against a word-by-word search."""

import hashlib
import re

import pytest

from crawlwright.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLDER = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=13):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        places = {}
        for i, word in enumerate(w):
            places.setdefault(word, []).append(i)
        for item, item_text in items:
            v = words(item_text)
            size = min(n, len(v))
            for a in range(len(v) - size + 1) if size and item is not None else ():
                for i in places.get(v[a], ()):
                    if w[i:i + size] == v[a:a + size]:
                        hit.update(range(i, i + size))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op1_decontamination(spark, FOLDER).collect()), key=repr)
    assert got == brute(docs, items) and any(r[2] for r in got)


LONG = " ".join(f"w{i}é" for i in range(20))
ITEMS = [(1, LONG), (2, "Short Item"), (3, None), (None, "lost words here"), (4, ""), (5, LONG), (6, "ünïcode")]
DOCS = [(1, None, 0), (2, "", 0), (3, f"x {LONG} y", 0), (3, f"x {LONG} y", 0), (4, "a short--ITEM; b", 0),
        (5, "shortitem", 0), (6, "short", 0), (7, "item" + " pad" * 200_000 + " short item", 0), (8, "lost words here", 0),
        (None, "ÜnÏcode ünïcode Ünïcode", 0), (9, LONG.upper().replace("É", "é"), 0), (10, "z" * 300_000 + " short item", 0)]


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 100])
def test_cases(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_words int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.contamination(docs, items, block_bytes=block).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(),
                     r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got), key=repr)
    assert found == brute([d[:2] for d in DOCS], ITEMS)
    kept = decontamination.decontaminated(docs, items, block_bytes=block)
    assert kept.columns == docs.columns
    bad = {r[0] for r in found if r[-1]}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d[0] for d in DOCS if d[0] not in bad), key=repr)
    cut = {r.doc_id: r.text for r in decontamination.decontaminated(docs, items, remove="spans", block_bytes=block).collect()}
    assert cut[3] == "x   y" and cut[4] == "a  ; b" and cut[6] == "short" and cut[7] == DOCS[7][1] and cut[1] is None


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.contamination(docs, none).collect()} == {0}
    assert decontamination.contamination(docs.limit(0), none).count() == 0
