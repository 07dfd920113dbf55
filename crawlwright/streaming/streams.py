"""Streaming twins of the ordered operators.

Rows carry event time and a watermark; later ones are dropped by Spark and
counted in the query progress. Keyed state is a few numbers. The steps are
the ones the batch operators fold with, so both agree on rows in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import alerts as A

LATENESS = "10 minutes"

#: Rows of a key that are a frame of Python values at once.
ROWS_AT_ONCE = 1 << 16
#: The type of a code, which no column of Spark comes in.
_CODE = np.uint32


class _Rows:
    """The rows of one key and micro-batch, which may be many: numbers as arrays, other values as codes of the distinct ones."""

    def __init__(self) -> None:
        self.parts: dict[str, list[pd.Series]] = {}
        self.books: dict[str, dict] = {}
        self.plain: set[str] = set()

    def add(self, batch: pd.DataFrame) -> None:
        for name in batch.columns:
            coded = self._coded(name, batch[name])  # may make the parts before it anew
            self.parts.setdefault(name, []).append(coded)

    def _coded(self, name: str, values: pd.Series) -> pd.Series:
        if values.dtype != object or name in self.plain:
            return values
        book = self.books.setdefault(name, {})
        try:
            return pd.Series(np.fromiter((book.setdefault(v, len(book)) for v in values), _CODE, len(values)))
        except TypeError:  # a value without a hash: the column stays as it came
            self.plain.add(name)
            self.parts[name] = [self._shown(name, p) for p in self.parts.get(name, [])]
            del self.books[name]
            return values

    def _shown(self, name: str, codes: pd.Series) -> pd.Series:
        values = np.empty(len(self.books[name]), dtype=object)
        values[:] = list(self.books[name])
        return pd.Series(values[codes.to_numpy()], dtype=object)

    def in_order(self, order: list[str]) -> Iterator[pd.DataFrame]:
        """Frames of some rows each, in a stable order."""
        whole: dict[str, pd.Series] = {}
        for name in list(self.parts):
            parts = self.parts.pop(name)
            if name in self.books:  # a batch without nulls may have come as numbers
                parts = [p if p.dtype == _CODE else self._coded(name, p.astype(object)) for p in parts]
            whole[name] = pd.concat(parts, ignore_index=True)
        keys = [self._shown(c, whole[c]) if c in self.books else whole[c] for c in order]
        if any(k.dtype == object for k in keys):
            at = pd.concat(keys, axis=1, keys=order).sort_values(order, kind="stable").index.to_numpy()
        else:
            at = np.lexsort([k.to_numpy() for k in reversed(keys)])
        del keys
        decoded = {c: self._shown(c, pd.Series(np.arange(len(b)))).to_numpy() for c, b in self.books.items()}
        for first in range(0, len(at), ROWS_AT_ONCE):
            some = at[first:first + ROWS_AT_ONCE]
            yield pd.DataFrame({c: pd.Series(decoded[c][v.to_numpy()[some]], dtype=object) if c in decoded
                                else v.take(some).reset_index(drop=True) for c, v in whole.items()})


def stateful(stream: DataFrame, keys: list[str], order: list[str], step: A.O.Step, init: dict, state_schema: str,
             outputs: str, lateness: str = LATENESS, idle_seconds: float | None = None,
             final: Callable[[dict], bool] | None = None) -> DataFrame:
    """Fold a stream per key; with ``idle_seconds``, the state of a key that idle is dropped.

    A drop is exact only where an idle key is back in its initial state. State
    that is ``final`` is dropped at once: nothing may follow it. A key's rows
    of a micro-batch are held as arrays and folded some at a time.
    """
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    names = [*stream.columns, *[p.split()[0] for p in outputs.split(",")]]
    fields = [p.split()[0] for p in state_schema.split(",")]

    def handle(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, latest = _Rows(), None
        for batch in batches:
            held.add(batch)
        now = dict(zip(fields, state.get)) if state.exists else dict(init)
        for rows in held.in_order(order):
            out, now = step(rows, now)
            last = rows["ts"].max()
            latest = last if latest is None or last > latest else latest
            yield out[names]
        if final is not None and final(now):
            state.remove()
            return
        state.update(tuple(now[f] for f in fields))
        if idle_seconds is not None:
            last = int(latest.timestamp() * 1000 + idle_seconds * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.EventTimeTimeout
    return stream.withWatermark("ts", lateness).groupBy(*keys).applyInPandasWithState(
        handle, f"{base}, {outputs}", state_schema, "append", timeout)


def breach_step(cooldown_seconds: float = A.COOLDOWN_SECONDS):
    """W10 and W11 in one: the run of breaches and the time of the last alert."""
    gap = int(cooldown_seconds * 1_000_000)

    def step(rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        run, last = int(state["run"]), state["last"]
        micros = rows["ts"].to_numpy("datetime64[us]").astype("int64")
        runs, sent = np.zeros(len(rows), dtype="int64"), np.zeros(len(rows), dtype=bool)
        for i, (level, need) in enumerate(zip(rows["severity"], rows["consecutive_failures"])):
            if level == "normal":
                run, last = 0, None
            else:
                run += 1
                if run >= need and (last is None or micros[i] - last >= gap):
                    sent[i], last = True, int(micros[i])
            runs[i] = run
        return rows.assign(run=runs, alert=sent), {"run": run, "last": last}
    return step


def alert_stream(samples: DataFrame, thresholds: DataFrame, rules: DataFrame, order: list[str] = ("ts", "seq"),
                 lateness: str = LATENESS, cooldown_seconds: float = A.COOLDOWN_SECONDS) -> DataFrame:
    """Alerts with the action of the first rule that holds."""
    rows = A.classify(samples, thresholds)
    runs = stateful(rows, ["name"], list(order), breach_step(cooldown_seconds), {"run": 0, "last": None}, "run bigint, last bigint",
                    "run bigint, alert boolean", lateness)
    return A.first_matching_rule(A.as_events(runs.filter("alert")), rules)


def windowed_statistics(samples: DataFrame, width: str = "10 minutes", slide: str = "1 minute",
                        lateness: str = LATENESS) -> DataFrame:
    """R2: sliding statistics per metric."""
    return (samples.withWatermark("ts", lateness).groupBy(F.window("ts", width, slide).alias("w"), "name")
            .agg(F.count("*").alias("samples"), F.avg("value").alias("average"), F.min("value").alias("min"),
                 F.max("value").alias("max"), F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("current"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "name", "samples", "average", "min",
                    "max", "current", F.when(F.col("current") > F.col("first"), "increasing")
                    .when(F.col("current") < F.col("first"), "decreasing").otherwise("stable").alias("trend")))


def latest_health(statuses: DataFrame) -> DataFrame:
    """Newest status per metric, for update or complete mode; of equal times the later ``seq`` is newer."""
    newest = F.max_by(F.struct("ts", "status"), F.struct("ts", "seq"))
    return statuses.groupBy("name").agg(newest.alias("_newest")).select("name", "_newest.ts", "_newest.status")


# Statuses from the best to the worst, as the overall state counts them.
STATUS_ORDER = ("unknown", "healthy", "warning", "critical")


def overall_health(latest: DataFrame) -> DataFrame:
    """The worst of the newest statuses; a status that is not listed counts as unknown."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")), F.lit(0)), F.lit(1))
    return latest.agg(F.element_at(F.array(*map(F.lit, STATUS_ORDER)), F.coalesce(F.max(rank), F.lit(1)).cast("int")).alias("status"))


def rate_limit_stream(requests: DataFrame, keys: list[str], rate: float = 10.0, capacity: float = 20.0,
                      order: list[str] = ("ts", "seq"), lateness: str = LATENESS) -> DataFrame:
    """Token bucket per key; a key idle long enough to be full again needs no state."""
    return stateful(requests, keys, list(order), A.token_bucket_step(rate, capacity), {"tokens": capacity, "last": None},
                    "tokens double, last bigint", "admitted boolean, tokens_left double, wait_seconds double",
                    lateness, idle_seconds=capacity / rate)


def host_health_stream(log: DataFrame, order: list[str] = ("ts", "seq"), lateness: str = LATENESS) -> DataFrame:
    """502 run and protection state per host; a host whose run is 0 again and that was never unhealthy needs no state."""
    start = {"run": 0, "unhealthy": False}
    return stateful(log, ["host"], list(order), A.health_step(), start, "run int, unhealthy boolean",
                    "run_502 int, unhealthy boolean", lateness, final=lambda state: state == start)


def progress_step():
    """Speed since the row before, and the status before."""
    def step(rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        micros = rows["ts"].to_numpy("datetime64[us]").astype("int64")
        size = rows["downloaded"].to_numpy("int64")
        first = state["ts"] is None
        before_t = np.concatenate(([micros[0] if first else state["ts"]], micros[:-1]))
        before_b = np.concatenate(([size[0] if first else state["bytes"]], size[:-1]))
        dt = (micros - before_t) / 1e6
        speed = np.where(dt > 0, (size - before_b) / np.where(dt > 0, dt, 1.0), 0.0)
        old = [state["status"], *rows["status"].tolist()[:-1]]
        out = rows.assign(speed=speed, old_status=old)
        return out, {"ts": int(micros[-1]), "bytes": int(size[-1]), "status": rows["status"].iloc[-1]}
    return step


def progress_stream(progress: DataFrame, order: list[str] = ("ts", "seq"), lateness: str = LATENESS) -> DataFrame:
    """Speed and status change of every progress row."""
    return stateful(progress, ["url"], list(order), progress_step(), {"ts": None, "bytes": 0, "status": None},
                    "ts bigint, bytes bigint, status string", "speed double, old_status string", lateness)


# Statuses after which an image does not change.
FINAL_STATUSES = ("completed", "failed", "cancelled")


def status_changes_stream(progress: DataFrame, task: str = "task_id", order: list[str] = ("ts", "seq"),
                          lateness: str = LATENESS) -> DataFrame:
    """+1 for the status an image enters and -1 for the one it leaves, in append mode.

    The sum of ``delta`` per task and status is the live count of images. An
    image's state is its last status, and goes when that is final.
    """
    rows = stateful(progress, [task, "url"], list(order), progress_step(), {"ts": None, "bytes": 0, "status": None},
                    "ts bigint, bytes bigint, status string", "speed double, old_status string", lateness,
                    final=lambda state: state["status"] in FINAL_STATUSES)
    moves = F.array(F.struct(F.col("status").alias("status"), F.lit(1).alias("delta")),
                    F.struct(F.col("old_status").alias("status"), F.lit(-1).alias("delta")))
    changed = rows.filter(~F.col("status").eqNullSafe(F.col("old_status")))
    return changed.select(task, "ts", F.inline(moves)).filter(F.col("status").isNotNull())


def status_counts(changes: DataFrame, task: str = "task_id") -> DataFrame:
    """Images per task and status, from the rows of :func:`status_changes_stream`."""
    return changes.groupBy(task, "status").agg(F.sum("delta").alias("n")).filter(F.col("n") > 0)


def error_stream(reports: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Reports per hour, level and type; the watermark bounds the state."""
    return (reports.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "level", "exception_type")
            .agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "level", "exception_type", "n"))


def callbacks(*functions: Callable[[DataFrame, int], None], log: Callable[[str], None] = print):
    """A ``foreachBatch`` function that calls all callbacks; one that fails is reported and skipped."""
    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for f in functions:
                try:
                    f(batch, epoch)
                except Exception as e:  # a callback must not stop the stream or the others
                    log(f"callback {getattr(f, '__name__', f)} failed: {e}")
        finally:
            batch.unpersist()
    return run

