"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

All of it is column expressions; no row leaves the JVM and nothing is
shuffled. Features are the distinct hash cells of the character n-grams of
host and path, each vector scaled to length one. The model is trained by full
gradient steps inside one row that holds the small labelled table both by url
and by cell; it is one array of weights, fixed in size, which scoring reads as
a constant.

Training uses at most ``max_labelled`` urls, those with the smallest hash.

Edge cases: a null url and one without ``://`` have an empty host and path and
are judged by the model; urls that are null or without label are not learned
from; with no labelled url, or of one label only, the model is its intercept;
repeated rows are each judged; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 1_000
CELLS = 1 << 13
GRAMS = (3, 4, 5)
STEPS, RATE, PENALTY = 200, 8.0, 5e-4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next slash, question or hash sign, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    """What follows the host up to a question or hash sign."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of the rules ``host/path`` that fit; of equally long ones the first in order."""
    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r in sorted(rules, key=lambda r: (-len(r), r))],
                      F.lit(None).cast("string"))


def _bound(value: Column, start: Column, use) -> Column:
    """``use(x)`` with ``x`` the value of an expression that is evaluated once."""
    return F.aggregate(F.array(value), start, lambda _, x: use(x))


def cells(host: Column, path: Column) -> Column:
    """The distinct cells of the n-grams of host and path, each with a mark at its ends."""
    def hashed(k: int, n: int, signs: Column) -> Column:
        last = F.size(signs) - n
        grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(
            F.xxhash64(F.lit(k), *[signs[i + j] for j in range(n)]), F.lit(CELLS)).cast("int"))
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<int>"))
    found = [_bound(F.split(F.concat(F.lit("\x02"), part, F.lit("\x03")), ""), F.array().cast("array<int>"),
                    lambda signs, k=k: F.concat(*[hashed(k, n, signs) for n in GRAMS]))
             for k, part in enumerate((host, path))]
    return F.array_distinct(F.concat(*found))


@dataclass(frozen=True)
class Model:
    """Weights of all cells and the intercept."""

    weights: tuple[float, ...]
    intercept: float

    def probability(self, cells: Column) -> Column:
        """How likely the url with these cells is to be one to block."""
        weights = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        total = F.aggregate(cells, F.lit(0.0), lambda s, c: s + weights[c])
        return 1 / (1 + F.exp(-(F.lit(self.intercept) + total / F.sqrt(F.greatest(F.size(cells), F.lit(1))))))


def trained(labelled: DataFrame, url_col: str = "url", label_col: str = "block", max_labelled: int = MAX_LABELLED) -> Model:
    """The model from urls with a label, true for those to block."""
    rows = (labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("boolean").alias("label")).dropna()
            .orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled)
            .select(F.col("label").cast("double").alias("y"), cells(host(F.col("url")), path(F.col("url"))).alias("cells"))
            .agg(F.array_sort(F.collect_list(F.struct("y", "cells"))).alias("rows")))
    # by cell: the rows that have it; then each row's cells as places in that list
    flat = rows.select("rows", F.array_sort(F.array_distinct(F.flatten(F.col("rows.cells")))).alias("names"))
    table = flat.select(
        "names", F.size("rows").alias("n"),
        F.transform("rows", lambda r: F.struct(
            r["y"].alias("y"), (1 / F.sqrt(F.size(r["cells"]))).alias("scale"),
            F.transform(r["cells"], lambda c: F.array_position("names", c).cast("int") - 1).alias("at"))).alias("by_row"),
        F.transform("names", lambda c: F.filter(F.transform(
            "rows", lambda r, i: F.when(F.array_contains(r["cells"], c), i)), lambda i: i.isNotNull())).alias("by_cell"))
    zero = F.struct(F.transform("names", lambda _: F.lit(0.0)).alias("w"), F.lit(0.0).alias("b"))

    def step(state: Column, _: Column) -> Column:
        wrong = F.transform("by_row", lambda r: (r["y"] - 1 / (1 + F.exp(-(state["b"] + r["scale"] * F.aggregate(
            r["at"], F.lit(0.0), lambda s, j: s + state["w"][j]))))) / F.col("n"))
        rows_of = F.col("by_row")
        return _bound(wrong, state, lambda e: F.struct(
            F.zip_with(state["w"], "by_cell", lambda w, own: w * (1 - RATE * PENALTY) + RATE * F.aggregate(
                own, F.lit(0.0), lambda s, i: s + e[i] * rows_of[i]["scale"])).alias("w"),
            (state["b"] + RATE * F.aggregate(e, F.lit(0.0), lambda s, x: s + x)).alias("b")))
    found = table.select("names", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step).alias("model")).first()
    weights = [0.0] * CELLS
    for cell, w in zip(found.names, found.model.w):
        weights[cell] = w
    return Model(tuple(weights), found.model.b)


def judged(pages: DataFrame, model: Model, allow: Sequence[str] = (), block: Sequence[str] = (), id_col: str = "page_id",
           url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` (or null), ``score`` of the model and ``verdict`` of every row.

    The rule's verdict holds where one fits, else a score of ``threshold`` or more blocks.
    """
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col), host(url).alias("__host"), path(url).alias("__path"))
    parts = parts.select(F.col(id_col).alias(id_col), F.coalesce("__host", F.lit("")).alias("host"),
                         F.coalesce("__path", F.lit("")).alias("path"))
    found = parts.select("*", matching_rule(F.col("host"), F.col("path"), [*allow, *block]).alias("rule"),
                         model.probability(cells(F.col("host"), F.col("path"))).alias("score"))
    verdict = (F.when(F.col("rule").isin(list(block)), "block").when(F.col("rule").isNotNull(), "allow")
               .when(F.col("score") >= threshold, "block").otherwise("allow"))
    return found.select("*", verdict.alias("verdict"))
