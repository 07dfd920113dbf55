"""Chat formatting: exact round trips, and paths of trees against a plain walk."""

import hashlib
import itertools
import re

from pyspark.sql import functions as F

from crawlwright.llm import chat, queries

FOLDER = "/root/testdata/sf0.01"
CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|<\|\w+\|>")
PARTS = ["<", "/", "s>", "[", "INST]", "\\", "<|im_end|>\n", "|a|>", "<<SYS>>", "é\n", "$1"]


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    known = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(rows, key=lambda r: r.turn):
        known.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: r for r in queries.op8_chat_formatting(spark, FOLDER).collect()}
    assert got.keys() == known.keys()
    for conv, turns in known.items():
        said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(24 + len(r) + len(t) + len(CONTROL.findall(t)) for r, t in turns)


def test_escapes(spark):
    texts = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product(PARTS, repeat=n)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in frame.select("*", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not CONTROL.search(r.e)


def formatted(spark, rows, top=1):
    frame = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double, leaf string")
    out = chat.formatted(frame, top, score_col="score").select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_texts(
        F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return sorted(((r.conv_id, r.leaf, [tuple(t) for t in r.turns], r.loss) for r in out.collect()), key=repr)


def test_tree(spark):
    rows = [(1, 10, None, "user", "q", 0.0, ""), (1, 11, 10, "assistant", "a", 1.0, ""), (1, 12, 10, "assistant", "b", 2.0, ""),
            (1, 13, 11, "user", "c", 5.0, ""), (1, 14, 12, "user", "d", 3.0, ""), (1, 15, 12, "user", "e", None, ""),
            (2, 10, 99, "ro\nle\\n", None, None, ""), (2, 11, 11, None, "self", 1.0, ""), (2, 12, 13, "user", "round", 1.0, ""),
            (2, 13, 12, "user", "round", 1.0, ""), (None, 1, None, "assistant", "</s>[/INST]\n<|im_end|>\n", 1.0, ""),
            (3, 1, None, "user", "twice", 1.0, ""), (3, 1, None, "user", "twice", 1.0, "")]
    one = [(1, 13, [("user", "q"), ("assistant", "a"), ("user", "c")], ["a"]),
           (2, 10, [("ro\nle\\n", "")], []), (2, 11, [("", "self")], []), (3, 1, [("user", "twice")], []),
           (None, 1, [("assistant", "</s>[/INST]\n<|im_end|>\n")], ["</s>[/INST]\n<|im_end|>\n"])]
    assert formatted(spark, rows) == sorted(one, key=repr)
    two = [*one, (1, 14, [("user", "q"), ("assistant", "b"), ("user", "d")], ["b"])]
    assert formatted(spark, rows, top=2) == sorted(two, key=repr)
    assert formatted(spark, rows[:0]) == []


def test_long(spark):
    rows = [(1, k, k - 1 if k else None, "assistant" if k % 2 else "user", f"t{k} é" * 50, 1.0, "") for k in range(700)]
    [(_, leaf, turns, loss)] = formatted(spark, rows)
    assert leaf == 699 and turns == [(r[3], r[4]) for r in rows] and loss == [r[4] for r in rows[1::2]]


def test_no_python(spark):
    plan = queries.op8_chat_formatting(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
