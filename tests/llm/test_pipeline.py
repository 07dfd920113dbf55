"""The pipeline against brute force over each stage's own input."""

import zlib

import numpy as np
from test_decontamination import brute as contaminated
from test_simhash import brute as near
from test_tokens import crc, plain, whole

import corpus_pipeline
from crawlwright.llm import toxicity

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, tmp_path):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = rows_of(kept), stage(spark, kept, FOLDER)
        assert out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        texts = [r[:2] for r in before]
        if name == "toxicity":
            model = toxicity.fitted(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            machine = model.automaton()
            gone = {i for i, t in texts if model.score(np.array([toxicity.features(t, machine)]))[0] >= 0.3}
        elif name == "simhash":
            gone = {i for i, _, c in near(texts) if i != c}
        else:
            gone = {r[0] for r in contaminated(texts, [tuple(r) for r in items.select("item_id", "text").collect()]) if r[-1]}
        assert rows_of(kept) == [r for r in before if r[0] not in gone]
        assert gone or name == "toxicity"
    left = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    for own, ids in whole(pieces, left):
        assert all(crc(ids[p.start:p.start + p.length]) == zlib.crc32(bytes(p.ids)) for p in own)


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and nothing at all."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "lone words here", None, "s", 3), (4, "long " * 90_000, "en", "s", 1),
            (5, "some words to keep", "en", "s", 1), (5, "some words to keep", "en", "s", 1), (6, "Some words to keep", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "7 AS fingerprint", "'x' AS score", "1L AS n_hit", "2 AS sequence_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    # 1 and 2 are equal (no words), 6 is 5 in other case; the null id stays, the repeated row is one document
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 5]
    assert sum(r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sum(
        len(plain(t, 0)) for i, t, *_ in rows if i not in (2, 6))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
