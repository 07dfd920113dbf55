"""Token counts against the library, and what the cache saves."""

import public_tokenizers
import sentencepiece

from crawlwright.llm import queries, tokencounts

FOLDER = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PROCESSOR = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def row(doc_id, text):
    n = len(PROCESSOR.encode(text or ""))
    return doc_id, len((text or "").encode()), n, n > 4096


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op6_token_counts(spark, FOLDER).collect())) == sorted(row(*d) for d in docs)


def test_cases(spark, tmp_path):
    cache = f"{tmp_path}/cache"
    rows = [(1, None), (2, ""), (3, "a </s> <s> b"), (4, " x  y\n\n"), (5, "é日本" * 9), (5, "again"), (6, "word " * 50_000), (7, "again"), (None, "z")]
    docs = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, digest binary")
    want = sorted((row(*r) for r in rows), key=repr)
    assert sorted(map(tuple, tokencounts.counted(docs, cache, MODEL).collect()), key=repr) == want
    assert tokencounts.cached(spark, cache).count() == len({t or "" for _, t in rows})
    more = docs.unionAll(spark.createDataFrame([(8, "new", b"")], docs.schema))
    assert sorted(map(tuple, tokencounts.counted(more, cache, MODEL).collect()), key=repr) == sorted([*want, row(8, "new")], key=repr)
    assert tokencounts.cached(spark, cache).count() == len({t or "" for _, t in rows}) + 1
    # a count of another version is not this one's
    spark.sql("SELECT unhex(sha2('other', 256)) digest, 'old' version, 99L n_tokens").write.mode("append").parquet(cache)
    other = spark.createDataFrame([(1, "other", b"")], docs.schema)
    assert tokencounts.counted(other, cache, MODEL).first().n_tokens == len(PROCESSOR.encode("other"))
    assert tokencounts.counted(docs.limit(0), cache, MODEL).count() == 0
    stored = spark.sql(f"SELECT unhex(sha2('known', 256)) digest, '{tokencounts.version_of(MODEL)}' version, 77L n_tokens")
    stored.unionAll(stored).write.mode("append").parquet(cache)  # what is stored is used, also twice
    assert [r.n_tokens for r in tokencounts.counted(spark.createDataFrame([(1, "known", b"")], docs.schema), cache, MODEL).collect()] == [77]
