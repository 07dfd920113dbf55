"""Toxicity: folding, exceptions, held-out accuracy."""

import math
import time

import pytest

from crawlwright.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.1"


def test_folding():
    assert toxicity.folded("St0pid, ѕtüріd​ Ｔrash! 1DIOT") == ["stopid", "stupid", "trash", "idiot"]
    assert toxicity.folded(None) == [] and toxicity.folded(" -- \n") == []


def test_features():
    model = toxicity.Model(((" trash ", 3.0), (" idiot", 2.0), (" idiotic ", 5.0)), ("trash can",), 0.0, (1.0, 1.0))
    machine = model.automaton()

    def density(text):
        return round(toxicity.features(text, machine)[1] * (len(toxicity.folded(text)) + toxicity._SMOOTH) / 100, 6)
    assert density("the trash-can and TR4SH") == 3.0
    assert density("trash trash. trashy") == 6.0
    assert density("idiots are id1otic") == 7.0
    assert density("") == 0 and toxicity.features("word", toxicity.Model((), (), 0, (1, 1)).automaton()) == (0.0, 0.0)


def test_held_out(spark):
    rows = queries.op5_toxicity(spark, FOLDER).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert sum(a and b for a, b in held) / sum(a for a, _ in held) > 0.9


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "x " * 50_000, 1.0), (None, "words", 1.0), (3, "a", 1.0)],
                                 "doc_id long, text string, score double")
    empty = toxicity.fitted(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert max(r.score for r in toxicity.scored(docs, empty).collect()) < 1e-9
    kept = toxicity.without_toxic(docs, empty)
    assert kept.columns == docs.columns and kept.count() == 5
    strict = toxicity.Model(((" words ", 9.0),), (), -1.0, (2.0, 0.0))
    assert sorted((r.doc_id or 0) for r in toxicity.without_toxic(docs, strict).collect()) == [1, 2, 3, 3]
    assert toxicity.scored(docs.limit(0), strict).count() == 0


def test_exceptions():
    """Entries inside any harmless phrase don't count, wherever phrases overlap or touch; the cost follows the matches."""
    model = toxicity.Model(((" trash ", 1.0), (" can", 2.0), (" dump ", 4.0)), ("trash can", "can trash", "dump trash can"), 0.0, (1.0, 0.0))

    def total(text):
        return round(math.expm1(toxicity.features(text, model.automaton())[0]), 6)
    assert [total(x) for x in ("trash", "trash can", "trash can trash", "trash dump", "x trash can dump", "dump trash can dump", "can", "cannot trash canoe")] == [
        1, 0, 0, 5, 4, 4, 2, 5]

    def seconds(n):
        start = time.perf_counter()
        toxicity.features("trash can trash dump " * n, model.automaton())
        return time.perf_counter() - start
    assert seconds(80_000) < 4 * min(seconds(40_000) for _ in range(3)) + 0.2
