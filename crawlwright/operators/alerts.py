"""Alert logic over time-ordered samples: breaches, cooldown, rules, rate limits, host health."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import progress as P
from . import ordered as O

# Alert and health limits.
COOLDOWN_SECONDS = 300
UNHEALTHY_502_RUN = 3
ROLLBACKS_PER_HOUR = 3
HOUR_MICROS = 3_600_000_000


def classify(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The severity of the samples of metrics with thresholds; other metrics are not watched.

    :func:`joins.with_thresholds` keeps every metric.
    """
    t = thresholds.select(F.col("name"), "warning", "critical", "consecutive_failures")
    rows = samples.join(t, "name")
    severity = (F.when(F.col("value") >= F.col("critical"), "critical")
                .when(F.col("value") >= F.col("warning"), "warning").otherwise("normal"))
    return rows.withColumn("severity", severity)


def breach_runs(samples: DataFrame, thresholds: DataFrame, order: list[str] = ("ts", "seq"),
                rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """Length of the breach run each sample is in, and whether it fires.

    The run is the position minus the position of the last normal sample;
    both are running aggregates, so no metric has to fit one task.
    """
    order = list(order)
    rows = O.chunked_or_whole(classify(samples, thresholds), ["name"], order, rows_per_chunk)
    rows = O.numbered(rows, ["name"], order, "_pos", rows_per_chunk)
    normal_at = F.when(F.col("severity") == "normal", F.col("_pos"))
    rows = O.running(rows, ["name"], order, {"_normal": O.Running("max", normal_at)}, rows_per_chunk)
    run = F.col("_pos") - F.coalesce(F.col("_normal"), F.lit(0))
    return (rows.withColumn("run", run)
            .withColumn("fires", (F.col("severity") != "normal") & (F.col("run") >= F.col("consecutive_failures")))
            .drop("_pos", "_normal", O.CHUNK))


def cooldown_step(cooldown_seconds: float = COOLDOWN_SECONDS):
    """Step of W11: suppress for the cooldown after an alert; a normal sample clears it."""
    gap = int(cooldown_seconds * 1_000_000)

    def step(rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        last = state["last"]
        micros = rows["ts"].to_numpy("datetime64[us]").astype("int64")
        fires, normal = rows["fires"].to_numpy(), (rows["severity"] == "normal").to_numpy()
        sent = np.zeros(len(rows), dtype=bool)
        for i in np.flatnonzero(fires | normal):
            if normal[i]:
                last = None
            elif last is None or micros[i] - last >= gap:
                sent[i], last = True, int(micros[i])
        return rows.assign(alert=sent), {"last": last}
    return step


def cooldown(runs: DataFrame, order: list[str] = ("ts", "seq"), cooldown_seconds: float = COOLDOWN_SECONDS,
             rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """Mark the samples that emit an alert."""
    return O.fold(runs, ["name"], list(order), cooldown_step(cooldown_seconds), {"last": None}, "last bigint",
                  "alert boolean", rows_per_chunk)


def first_matching_rule(events: DataFrame, rules: DataFrame, event_id: str = "event_id") -> DataFrame:
    """The action of the first enabled rule that holds, null when none does.

    The rules of a metric are grouped into one array and joined once, so an
    event stays one row and nothing is ranked.
    """
    packed = rules.filter("enabled").groupBy(F.col("metric_name").alias("name")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "rule_id", "condition", "threshold", "action"))).alias("_rules"))
    joined = events.join(packed, "name", "left")
    hit = F.get(F.filter("_rules", lambda r: P.holds(F.col("value"), r["condition"], r["threshold"])), 0)
    return (joined.withColumn("_hit", hit)
            .withColumn("rule_id", F.col("_hit.rule_id"))
            .withColumn("action_taken", F.coalesce(F.col("_hit.action"), F.lit("")))
            .drop("_rules", "_hit"))


def alert_events(samples: DataFrame, thresholds: DataFrame, rules: DataFrame,
                 order: list[str] = ("ts", "seq"), rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """W10, W11 and J5 in one: the alert rows with threshold, message and action."""
    runs = breach_runs(samples, thresholds, order, rows_per_chunk)
    sent = cooldown(runs, order, rows_per_chunk=rows_per_chunk).filter("alert")
    return first_matching_rule(as_events(sent), rules)


def as_events(sent: DataFrame) -> DataFrame:
    """Alert samples with threshold, id and message."""
    limit = F.when(F.col("severity") == "critical", F.col("critical")).otherwise(F.col("warning"))
    return (sent.withColumn("threshold_value", limit)
            .withColumn("event_id", F.concat("name", F.lit("_"), F.unix_seconds("ts").cast("string")))
            .withColumn("message", F.format_string("指标 %s 异常: 当前值 %s", "name", F.col("value").cast("string"))))


def _admitted(micros: list, need: list, fresh: list, state: tuple | None, rate: float, capacity: float) -> tuple[list, list, list, tuple]:
    """(admitted, tokens left, seconds to wait, state) of requests in order; a fresh row finds a full bucket."""
    tokens, last = state or (capacity, None)
    admitted, left, wait = [], [], []
    for t, n, new in zip(micros, need, fresh):
        if new:
            tokens, last = capacity, None
        if t is not None:
            if last is not None and t > last:
                tokens = min(capacity, tokens + (t - last) / 1e6 * rate)
            last = t if last is None else max(last, t)
        ok = n is not None and tokens >= n
        if ok:
            tokens -= n
        admitted.append(ok)
        left.append(tokens)
        wait.append(0.0 if ok else None if n is None else (n - tokens) / rate)
    return admitted, left, wait, (tokens, last)


def token_bucket_step(rate: float, capacity: float):
    """Step of W13: refill by elapsed time up to the capacity, then admit if there are enough tokens."""
    def step(rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        start = (capacity if state["tokens"] is None else float(state["tokens"]), state["last"])
        micros = rows["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
        admitted, left, wait, (tokens, last) = _admitted(micros, rows["need"].astype(float).tolist(), [False] * len(rows), start, rate, capacity)
        return rows.assign(admitted=admitted, tokens_left=left, wait_seconds=wait), {"tokens": tokens, "last": last}
    return step


#: Cells of the session grid that are scanned together.
CELLS = 4096


def sessions(rows: DataFrame, keys: list[str], ts: str, gap_micros: int, cells: int = CELLS) -> DataFrame:
    """``_session``: rows of a key are in one session only if no gap before them surely exceeds ``gap_micros``.

    Time is a grid of cells as long as the gap. Where a key's cell has no
    occupied cell before it, the gap is longer and a session starts, named by that cell.
    Occupied cells are few rows, combined before they are shuffled; the
    last start up to each is a running maximum over chunks of the grid. Rows without a time are a session.
    """
    rows = rows.withColumn("_cell", O.floored(F.unix_micros(F.col(ts)), gap_micros))
    cell = F.col("_cell")
    seen = rows.select(*keys, "_cell").distinct()
    marks = seen.select(*keys, "_cell", F.lit(0).alias("_kind")).unionAll(seen.select(*keys, (cell + 1).alias("_cell"), F.lit(1)))
    found = marks.groupBy(*keys, "_cell").agg(F.min("_kind").alias("_own"), F.max("_kind").alias("_follows")).where("_own = 0")
    start = F.when(F.col("_follows") == 0, cell)
    named = O.running(O.on_grid(found, cell, cells), keys, ["_cell"], {"_session": O.Running("max", start)})
    return O.join_on_keys(rows, named.select(*keys, "_cell", "_session"), [*keys, "_cell"]).drop("_cell")


def token_bucket(requests: DataFrame, keys: list[str], rate: float = 10.0, capacity: float = 20.0,
                 order: list[str] = ("ts", "seq"), cells: int = CELLS) -> DataFrame:
    """Admission per key; ``need`` tokens per row, the bucket starts full.

    After a pause of capacity / rate seconds a bucket is full whatever was
    before, so a key is cut there into sessions that are swept apart from one
    another, each in order. Requests without a time add no tokens and are a session of
    their own; a request without a need is refused and waits for nothing.
    """
    gap = math.ceil(1e6 * capacity / rate) + 1
    rows = sessions(requests, keys, "ts", gap, cells)

    def sweep(columns: dict, fresh: np.ndarray, state):
        *made, state = _admitted(columns["ts"].cast(pa.int64()).to_pylist(), columns["need"].cast(pa.float64()).to_pylist(),
                                 fresh.tolist(), state, rate, capacity)
        return [pa.array(x, t) for x, t in zip(made, (pa.bool_(), pa.float64(), pa.float64()))], state
    return O.swept(rows, [*keys, "_session"], list(order), ["ts", "need"], sweep,
                   "admitted boolean, tokens_left double, wait_seconds double").drop("_session")


def health_step(limit: int = UNHEALTHY_502_RUN):
    """Step of W14: a 502 lengthens the run, a success clears it, anything else shortens it by one."""
    def step(rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        run, bad = int(state["run"]), bool(state["unhealthy"])
        runs, flags = [], []
        for s in rows["status"].tolist():
            if s == 502:
                run += 1
                bad = bad or run >= limit
            elif 200 <= s < 300:
                run = 0
            else:
                run = max(0, run - 1)
            runs.append(run)
            flags.append(bad)
        return rows.assign(run_502=runs, unhealthy=flags), {"run": run, "unhealthy": bad}
    return step


def host_health(log: DataFrame, order: list[str] = ("ts", "seq"), limit: int = UNHEALTHY_502_RUN,
                grid_micros: int = HOUR_MICROS) -> DataFrame:
    """502 run and protection state per host, as running sums, minima and maxima.

    A step is max(0, run + 1) or max(0, run - 1), or 0 after a success. Between
    successes the steps compose to the sum of their ones, less its lowest value so far if
    that is below 0. Chunks of the time grid complete one another,
    so a host with most rows is spread by time. A status that is null or no success shortens the run.
    """
    order, columns = list(order), log.columns
    status = F.col("status")
    good = F.coalesce((status >= 200) & (status < 300), F.lit(False))
    step = F.when(good, 0).when(status == 502, 1).otherwise(-1).cast("bigint")
    rows = O.on_grid(log, F.unix_micros(F.col(order[0])), grid_micros)
    rows = O.running(rows, ["host"], order, {"_sum": O.Running("sum", step), "_part": O.Running("sum", good.cast("bigint"))})
    floor = F.when(F.col("_part") == 0, F.least(F.col("_sum"), F.lit(0))).otherwise(F.col("_sum"))  # every run begins at 0
    rows = O.running(rows, ["host", "_part"], order, {"_low": O.Running("min", floor)})
    rows = rows.withColumn("run_502", (F.col("_sum") - F.col("_low")).cast("int"))
    rows = O.running(rows, ["host"], order, {"_most": O.Running("max", F.col("run_502"))})
    return rows.select(*columns, "run_502", (F.col("_most") >= limit).alias("unhealthy"))


def hourly_limit(events: DataFrame, keys: list[str], limit: int = ROLLBACKS_PER_HOUR, ts: str = "ts",
                 span_micros: int = HOUR_MICROS, rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """Is there room for an action, given the events of the hour before it?

    Counted from running counts per time stamp: those before this instant
    minus those an hour back or older. Both ends are events of one ordered
    scan, so a hot key needs no wide frame in one task.
    """
    t = F.unix_micros(F.col(ts))
    per_instant = events.groupBy(*keys, t.alias("_t")).agg(F.count("*").alias("_n"))
    marks = per_instant.select(*keys, "_t", F.lit(1).alias("_kind"), F.col("_n")).unionByName(
        per_instant.select(*keys, (F.col("_t") - span_micros).alias("_t"), F.lit(2).alias("_kind"),
                           F.lit(0).cast("bigint").alias("_n")))
    upto = O.running(marks, keys, ["_t", "_kind"], {"_upto": O.Running("sum", F.col("_n"))}, rows_per_chunk)
    now = upto.filter("_kind = 1").select(*keys, "_t", (F.col("_upto") - F.col("_n")).alias("_before"))
    old = upto.filter("_kind = 2").select(*keys, (F.col("_t") + span_micros).alias("_t"), F.col("_upto").alias("_old"))
    counts = now.join(old, [*keys, "_t"]).select(*keys, "_t", (F.col("_before") - F.col("_old")).alias("recent"))
    rows = events.withColumn("_t", t)
    return rows.join(counts, [*keys, "_t"]).drop("_t").withColumn("allowed", F.col("recent") < limit)


def limit_alerts(samples: DataFrame, limits: DataFrame, order: list[str] = ("ts", "seq")) -> DataFrame:
    """the latest usage per resource against its soft and hard limit; above the hard one gives two rows."""
    latest = samples.groupBy("name").agg(F.max_by(F.struct("value", "ts"), F.struct(*order)).alias("_last"))
    rows = latest.select("name", "_last.*").join(limits.filter("enabled"), "name")
    def over(kind, col):
        return F.when(F.col("value") > F.col(col), F.struct(
            F.lit(kind).alias("alert_type"), F.col(col).alias("threshold_value")))
    hits = F.array_compact(F.array(over("soft_limit", "soft_limit"), over("hard_limit", "hard_limit")))
    return rows.withColumn("_hit", F.explode(hits)).select("name", "ts", "value", "_hit.*")


def bound_alerts(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """max bounds fire above, min bounds fire below. ``bounds(name, kind, threshold)``."""
    rows = samples.join(bounds, "name")
    hit = ((F.col("kind") == "max") & (F.col("value") > F.col("threshold"))) | (
        (F.col("kind") == "min") & (F.col("value") < F.col("threshold")))
    return rows.filter(hit)


def capacity_check(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """does the required amount fit, and the headroom; unlimited without an enabled limit."""
    lim = limits.select("name", "max_value", F.col("enabled").alias("_enabled"))
    rows = requests.join(lim, "name", "left")
    current = F.coalesce(F.col("current"), F.lit(0.0))
    active = F.coalesce(F.col("_enabled"), F.lit(False))
    return (rows.withColumn("available", ~active | (current + F.col("required") <= F.col("max_value")))
            .withColumn("headroom", F.when(F.col("max_value").isNull(), F.lit(float("inf"))).otherwise(
                F.greatest(F.lit(0.0), F.col("max_value") - current))).drop("_enabled"))
