"""Ordered computations that survive a key holding a third of all rows.

A window partitioned by such a key would run in one task. Here the rows are
range-partitioned by key and order instead, so that a hot key is spread over
many chunks of equal size. A scan (running sum, previous row, position) runs
inside each chunk and is completed by a carry from the chunks before it; the
carries are one small row per key and chunk.  A fold whose steps depend on
each other (cooldown) runs per chunk from a guessed entry state and repeats
only the chunks whose guess was wrong; one that is cut into sessions (token
bucket) sweeps over sorted rows.

Rows with a place on a grid (:func:`on_grid`) are cut by it, at every size alike. Other
inputs of at most ``rows_per_chunk`` rows, counted first, take the plain
window or group: they fit one task whatever the keys look like.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_CHUNK = 2_000_000
CHUNK = "_chunk"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate files; a scratch folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="crawlwright-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: for large ones of which each reader wants some rows or columns."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(df: DataFrame, keys: list[str], order: list[str],
            rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame | None:
    """Rows in range chunks of (keys, order), numbered by ``_chunk``; None when one chunk is enough.

    The numbers come from the partition a row landed in, so they are fixed by
    a checkpoint before anything is computed from them.
    """
    if CHUNK in df.columns:
        return df
    n = math.ceil(df.count() / rows_per_chunk)
    if n <= 1:
        return None
    ranged = df.repartitionByRange(n, *keys, *order)
    return checkpointed(ranged.withColumn(CHUNK, F.spark_partition_id()))


def chunked_or_whole(df: DataFrame, keys: list[str], order: list[str],
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The rows chunked once for several scans over the same keys and order; unchanged when they are few."""
    parts = chunked(df, keys, order, rows_per_chunk)
    return df if parts is None else parts


_COMBINE = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``sum``, ``max`` or ``min`` of a column, current row included."""

    agg: str
    value: Column

    def over(self, value: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.agg](value)


def running(df: DataFrame, keys: list[str], order: list[str], scans: dict[str, Running],
            rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """W9 in general: running aggregates per key over all rows up to the current one.

    Null values are skipped; a result is null while no value has been seen.
    """
    parts = chunked(df, keys, order, rows_per_chunk)
    if parts is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[s.over(s.value).over(w).alias(n) for n, s in scans.items()])
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = parts.select("*", *[s.over(s.value).over(local).alias(n) for n, s in scans.items()])
    totals = parts.groupBy(*keys, CHUNK).agg(*[s.over(s.value).alias(n) for n, s in scans.items()])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(*keys, CHUNK, *[s.over(F.col(n)).over(before).alias(f"_carry_{n}") for n, s in scans.items()])
    joined = join_on_keys(inner, carries, [*keys, CHUNK])

    def merged(n, s):
        own, carry = F.col(n), F.col(f"_carry_{n}")
        return F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(_COMBINE[s.agg](own, carry)).alias(n)
    return joined.select(*df.columns, *[merged(n, s) for n, s in scans.items()])


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe equality of the keys."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])


def previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str],
             rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Value of columns in the row before, per key: ``{new name: column}``."""
    parts = chunked(df, keys, order, rows_per_chunk)
    if parts is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(n) for n, c in columns.items()])
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    inner = parts.select("*", *[F.lag(c).over(w).alias(n) for n, c in columns.items()],
                         F.row_number().over(w).alias("_at"))
    last = F.max_by(F.struct(*set(columns.values())), F.struct(*order)).alias("_last")
    ends = parts.groupBy(*keys, CHUNK).agg(last)
    over = Window.partitionBy(*keys).orderBy(CHUNK)
    carries = ends.select(*keys, CHUNK, F.lag("_last").over(over).alias("_carry"))
    joined = join_on_keys(inner, carries, [*keys, CHUNK])
    first = F.col("_at") == 1
    return joined.select(*df.columns, *[
        F.when(first, F.col(f"_carry.{c}")).otherwise(F.col(n)).alias(n) for n, c in columns.items()])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn",
             rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Position of each row per key, from 1."""
    out = running(df, keys, order, {name: Running("sum", F.lit(1).cast("bigint"))}, rows_per_chunk)
    return out


def order_statistics(df: DataFrame, keys: list[str], value: str, positions: Callable[[Column], dict[str, Column]],
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Values at given 0-based positions of the sorted values of each key.

    Equal values are counted before anything is shuffled by order, and a
    position is found from running counts, so no group is ever collected.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranks = running(counts, keys, [value], {"_upto": Running("sum", F.col("_n"))}, rows_per_chunk)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rows = join_on_keys(ranks, totals, keys)
    found = {}
    for name, pos in positions(F.col("_total")).items():
        inside = (F.col("_upto") > pos) & (F.col("_upto") - F.col("_n") <= pos)
        found[name] = F.max(F.when(inside, F.col(value))).alias(name)
    return rows.groupBy(*keys).agg(*found.values())


# ------------------------------------------------------------ grids and sweeps

def on_grid(df: DataFrame, place: Column, cells: int) -> DataFrame:
    """Chunks that follow from the rows alone: ``cells`` steps of an integer place on the order.

    Nothing is counted or sampled, so every use of the rows sees the same chunks, however often a task runs again.
    The place must not fall along the order; rows of a null place form the first chunk.
    """
    return df.withColumn(CHUNK, floored(place, cells))


def floored(place: Column, step: int) -> Column:
    """The whole number of steps at or below an integer place."""
    place = place.cast("bigint")
    step = F.lit(step).cast("bigint")
    return F.call_function("div", place - F.pmod(place, step), step)


Sweep = Callable[[dict, np.ndarray, object], tuple[list, object]]


def swept(df: DataFrame, keys: list[str], order: list[str], columns: list[str], sweep: Sweep, outputs: str) -> DataFrame:
    """Fold the rows of each key in order as one sorted stream per task.

    Rows are dealt out by key and sorted, with spill, by key and order; batches
    pass ``sweep(arrays of the columns, first rows of their keys, state)``, which returns the
    output arrays and the state for the next batch. No key is ever held
    together, so a long one costs time in its task but no memory.
    """
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    own = df.columns
    places = [own.index(k) for k in keys]
    names = [*own, *[x.split()[0] for x in outputs.split(",")]]

    def scan(batches):
        before, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            for k in places:
                code = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
                fresh[1:] |= code[1:] != code[:-1]
            first = [batch.column(k)[0].as_py() for k in places]
            fresh[0] = first != before
            before = [batch.column(k)[batch.num_rows - 1].as_py() for k in places]
            made, state = sweep({c: batch.column(own.index(c)) for c in columns}, fresh, state)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(scan, f"{base}, {outputs}")


# --------------------------------------------------------------------- folds

Step = Callable[[pd.DataFrame, dict], tuple[pd.DataFrame, dict]]


def _fold_group(step: Step, init: dict, order: list[str], columns: list[str]):
    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = step(pdf.sort_values(order, kind="stable").reset_index(drop=True), dict(init))
        return out[columns]
    return apply


def fold(df: DataFrame, keys: list[str], order: list[str], step: Step, init: dict, state_schema: str,
         outputs: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Sequential fold per key in order, adding the ``outputs`` columns.

    ``step(rows, state)`` handles a run of rows and returns them with the new
    columns plus the state after them; it must give the same result however
    the rows are cut into runs.
    """
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema = f"{base}, {outputs}"
    names = [*df.columns, *[p.split()[0] for p in outputs.split(",")]]
    parts = chunked(df, keys, order, rows_per_chunk)
    if parts is None:
        return df.groupBy(*keys).applyInPandas(_fold_group(step, init, order, names), schema)

    state_names = [p.split()[0] for p in state_schema.split(",")]
    entry_cols = [f"_in_{n}" for n in state_names]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def entry_state(pdf):
        row = pdf.iloc[0]
        return {n: (None if pd.isna(row[e]) else row[e]) for n, e in zip(state_names, entry_cols)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = step(pdf.sort_values(order, kind="stable").reset_index(drop=True), entry_state(pdf))
        return out[names]

    def exit_of(pdf: pd.DataFrame) -> pd.DataFrame:
        _, state = step(pdf.sort_values(order, kind="stable").reset_index(drop=True), entry_state(pdf))
        first = pdf.iloc[0]
        return pd.DataFrame([{**{k: first[k] for k in keys}, CHUNK: first[CHUNK],
                              **{f"_out_{n}": state[n] for n in state_names}}])

    out_schema = f"{key_schema}, {CHUNK} int, " + ", ".join(f"_out_{p.strip()}" for p in state_schema.split(","))
    types = dict(p.split() for p in state_schema.split(","))
    start = [F.lit(init[n]).cast(types[n]).alias(e) for n, e in zip(state_names, entry_cols)]
    chunks = checkpointed(parts.select(*keys, CHUNK).distinct().select("*", *start))
    todo, exits, rounds = chunks, None, 0
    while True:
        work = parts.join(todo, [*keys, CHUNK])
        fresh = work.groupBy(*keys, CHUNK).applyInPandas(exit_of, out_schema)
        if exits is None:
            exits = checkpointed(fresh)
        else:
            exits = checkpointed(exits.join(todo.select(*keys, CHUNK), [*keys, CHUNK], "left_anti").unionByName(fresh))
        over = Window.partitionBy(*keys).orderBy(CHUNK)
        is_first = F.row_number().over(over) == 1
        entries = exits.select(*keys, CHUNK, *[
            F.when(is_first, s).otherwise(F.lag(f"_out_{n}").over(over)).alias(e)
            for s, n, e in zip([F.lit(init[n]).cast(types[n]) for n in state_names], state_names, entry_cols)])
        old = chunks.select(*keys, CHUNK, *[F.col(e).alias(f"_old{e}") for e in entry_cols])
        both = entries.join(old, [*keys, CHUNK])
        same = F.lit(True)
        for e in entry_cols:
            same = same & F.col(e).eqNullSafe(F.col(f"_old{e}"))
        both = checkpointed(both.withColumn("_same", same))
        chunks = both.select(*keys, CHUNK, *entry_cols)
        todo = both.filter(~F.col("_same")).select(*keys, CHUNK, *entry_cols)
        rounds += 1
        if rounds > 1:
            # most guesses are settled now; of what is left only the first chunk per key has a
            # final entry, so later ones wait instead of being run once per round
            first = todo.groupBy(*keys).agg(F.min(CHUNK).alias("_first"))
            chunks = chunks.join(first, keys, "left")
            waits = F.col(CHUNK) > F.coalesce("_first", F.lit(2**31 - 1))
            chunks = checkpointed(chunks.join(old, [*keys, CHUNK]).select(*keys, CHUNK, *[
                F.when(waits, F.col(f"_old{e}")).otherwise(F.col(e)).alias(e) for e in entry_cols]))
            todo = todo.join(first, keys).filter(F.col(CHUNK) == F.col("_first")).drop("_first")
        if todo.isEmpty():
            break
    work = parts.join(chunks, [*keys, CHUNK])
    return work.groupBy(*keys, CHUNK).applyInPandas(run, schema)
