"""Chat formatting: the best paths of reply trees, each as one conversation.

A reply tree has messages that name their parent. Iterative self-joins double
the distance that each message sees towards its root, so the number of joins
is the logarithm of the deepest tree; they give every message its root and the
score of its branch. The leaves of a root are ranked by that score and the
best ``top`` are chosen. The same joins, applied again to the chosen leaves,
list the messages of each path, which are joined to their texts and formatted.
Everything is DataFrame operations; what one row holds is one conversation.

Template: a turn is ``<|im_start|>``, role, line feed, text, ``<|im_end|>``
and a line feed. Control strings inside a text or role (``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``, ``<|name|>``) get a
backslash after their first sign, one more if they have some already, so no
text holds one and the escape can be undone; other text stays as it is. A
role's backslashes and line feeds are written ``\\b`` and ``\\n``.

Edge cases: a null text or role is empty; a message whose parent is null,
missing or itself is a root; of messages that repeat an id in one conversation
the first in order of parent, role and text stays; messages on a circle of
parents have no root and are on no path; a null score is 0; an empty table
gives no conversation; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

START, END = "<|im_start|>", "<|im_end|>\n"
_ANGLE = r"(?=/?s>|</?SYS>>|\|\w+\|>)"
_BRACKET = r"(?=/?INST\])"


def escaped(text: Column) -> Column:
    """``text`` without any control string."""
    text = F.regexp_replace(text, rf"<(\\*){_ANGLE}", r"<\\$1")
    return F.regexp_replace(text, rf"\[(\\*){_BRACKET}", r"[\\$1")


def unescaped(text: Column) -> Column:
    """The text that :func:`escaped` was given."""
    text = F.regexp_replace(text, rf"<\\(\\*){_ANGLE}", "<$1")
    return F.regexp_replace(text, rf"\[\\(\\*){_BRACKET}", "[$1")


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _plain_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """``conv``, ``leaf``, ``id`` and ``up`` (messages between it and the leaf) of the best ``top`` paths of each root.

    ``messages`` has ``conv``, ``id``, ``parent`` and ``score``, ids distinct in a conversation.
    """
    own = messages.select("conv", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    a, b = own.alias("a"), own.alias("b")
    linked = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.parent") == F.col("b.id")), "left").select(
        "a.conv", "a.id", F.when(F.col("b.id") != F.col("a.id"), F.col("b.id")).alias("parent"), "a.score")
    # each message: the message 2^k above it, the topmost one seen so far, and the score up to there
    state = stored(linked.select("conv", "id", F.col("parent").alias("above"), F.col("id").alias("root"), "score"), "replies")
    jumps, n = [], state.count()
    while (open_ := state.where(F.col("above").isNotNull())).limit(1).count() and 1 << len(jumps) <= 2 * n:
        jumps.append(open_)
        s, t = open_.alias("s"), state.alias("t")
        further = s.join(t, F.col("s.conv").eqNullSafe(F.col("t.conv")) & (F.col("s.above") == F.col("t.id"))).select(
            "s.conv", "s.id", "t.above", "t.root", (F.col("s.score") + F.col("t.score")).alias("score"))
        state = stored(state.where(F.col("above").isNull()).unionAll(further), "replies")  # what has its root rests
    replied = jumps[0].select("conv", F.col("above").alias("id")) if jumps else state.limit(0).select("conv", "id")
    rooted = state.where(F.col("above").isNull())
    leaves = rooted.alias("a").join(replied.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv"))
                                    & (F.col("a.id") == F.col("b.id")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv", "root").orderBy(F.desc("score"), "id"))
    found = leaves.select("*", rank.alias("rank")).where(F.col("rank") <= top).select(
        "conv", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        p, j = found.alias("p"), jump.alias("j")
        further = p.join(j, F.col("p.conv").eqNullSafe(F.col("j.conv")) & (F.col("p.id") == F.col("j.id"))).select(
            "p.conv", "leaf", F.col("j.above").alias("id"), (F.col("up") + F.lit(1 << k)).alias("up"))
        found = stored(found.unionAll(further), "paths")
    return found


def formatted(messages: DataFrame, top: int = 1, conv_col: str = "conv_id", id_col: str = "msg_id", parent_col: str = "parent_id",
              role_col: str = "role", text_col: str = "text", score_col: str | None = None,
              learn_role: str = "assistant") -> DataFrame:
    """One row per chosen path.

    Returns ``conv_col``, ``leaf`` (the id of its last message), ``formatted``
    and ``loss_spans``: where in it, by code points, the texts of
    ``learn_role`` stand.
    """
    score = F.col(score_col).cast("double") if score_col else F.lit(0.0)
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent"),
                           F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                           F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), score.alias("score"))
    rows = rows.groupBy("conv", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("conv", "id", "m.*")
    rows = stored(rows, "messages")
    p, m = paths(rows.drop("role", "text"), top).alias("p"), rows.alias("m")
    turns = p.join(m, F.col("p.conv").eqNullSafe(F.col("m.conv")) & (F.col("p.id") == F.col("m.id"))).select(
        "p.conv", "leaf", "up", "role", F.concat(F.lit(START), _role(F.col("role")), F.lit("\n")).alias("head"),
        escaped(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("conv", "leaf").orderBy(F.desc("up")).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.length("head")
    spans = turns.select("conv", "leaf", F.struct(
        (-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("role") == learn_role, F.struct(start.cast("long").alias("start"),
                                                     (start + F.length("body")).cast("long").alias("end"))).alias("span")).alias("turn"))
    whole = spans.groupBy("conv", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select(F.col("conv").alias(conv_col), "leaf", F.array_join("turns.piece", "").alias("formatted"),
                        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    bodies = F.transform(pieces, lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x)))
    return F.transform(bodies, lambda x: F.struct(
        _plain_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescaped(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1,
                                                              (s["end"] - s["start"]).cast("int"))))
