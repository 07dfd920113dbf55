"""Chunked scans and folds give what one window or one sequential pass gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crawlwright.operators import alerts as A
from crawlwright.operators import ordered as O
from crawlwright.operators import planning, stats

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        name = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c"])
        rows.append((name, START + dt.timedelta(seconds=i * rng.choice([1, 20, 90])), i, float(rng.randint(0, 100))))
    rows.sort(key=lambda r: r[1])
    rows = [(n, t, i, v) for i, (n, t, _, v) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "name string, ts timestamp, seq bigint, value double").cache()


def as_dict(df, *cols):
    return {r["seq"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_running_and_previous(series):
    rows, df = series
    big = as_dict(stats.running_totals(df), "total")
    assert big == as_dict(stats.running_totals(df, rows_per_chunk=50), "total")
    lag = lambda n: as_dict(O.previous(df, ["name"], ["ts", "seq"], {"before": "value"}, n), "before")
    assert lag(10_000) == lag(50)
    last = {}
    for name, _, seq, value in rows:
        assert lag_value(last, name) == big_lag(lag(10_000), seq) if seq < 3 else True
        last[name] = value


def lag_value(last, name):
    return last.get(name)


def big_lag(found, seq):
    return found[seq][0]


def test_order_statistics(series):
    rows, df = series
    for n in (10_000, 60):
        got = {r["name"]: r for r in stats.metric_statistics(df, rows_per_chunk=n).collect()}
        for name in ("hot", "a", "b", "c"):
            values = sorted(v for k, _, _, v in rows if k == name)
            assert got[name]["p90"] == values[int(len(values) * 0.9)]
            assert got[name]["p99"] == values[int(len(values) * 0.99)]
            mid = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
            assert got[name]["median"] == got[name]["p50"] == mid


def test_small_samples(spark):
    df = spark.createDataFrame([("x", START, 0, 5.0)] + [("y", START, i, float(i)) for i in range(9)]
                               + [("z", START, i, float(i)) for i in range(10)], "name string, ts timestamp, seq bigint, value double")
    got = {r["name"]: r for r in stats.metric_statistics(df).collect()}
    assert got["x"]["median"] is None and got["x"]["stdev"] is None
    assert got["y"]["p90"] is None and got["y"]["median"] == 4.0
    assert got["z"]["p90"] == 9.0 and got["z"]["p50"] == 4.5


def brute_bucket(rows, rate, cap):
    state, out = {}, {}
    for name, t, seq, _ in rows:
        tokens, last = state.get(name, (cap, t))
        tokens = min(cap, tokens + (t - last).total_seconds() * rate)
        ok = tokens >= 1
        out[seq] = (ok,)
        state[name] = (tokens - 1 if ok else tokens, t)
    return out


@pytest.mark.parametrize("rate, cap, cells", [(1 / 32, 2.0, 4096), (1 / 32, 2.0, 3), (1 / 1000, 4.0, 1), (2.0, 2.0, 7)])
def test_token_bucket(series, rate, cap, cells):
    rows, df = series
    got = A.token_bucket(df.withColumn("need", F.lit(1)), ["name"], rate, cap, cells=cells)
    assert as_dict(got, "admitted") == brute_bucket(rows, rate, cap)
    assert got.columns == ["name", "ts", "seq", "value", "need", "admitted", "tokens_left", "wait_seconds"]


def test_sessions(spark):
    """A key with most rows is cut into many sessions, of which none falls on both sides of a pause that may fill a bucket."""
    rng, rows, at = random.Random(8), [], 0.0
    for i in range(4_000):
        at += rng.choice([0.2, 0.5, 1.0, 1.9, 2.5, 3.9, 4.1, 60.0])
        rows.append(("hot" if i % 8 else f"k{i % 5}", START + dt.timedelta(seconds=at), i, 0.0))
    df = spark.createDataFrame(rows, "name string, ts timestamp, seq bigint, value double")
    found = A.sessions(df, ["name"], "ts", 2_000_001, cells=50).collect()
    members = {}
    for r in found:
        members.setdefault((r["name"], r["_session"]), []).append(r["ts"])
    hot = [m for (name, _), m in members.items() if name == "hot"]
    assert len(hot) > 500 and max(map(len, hot)) < 100
    spans = sorted((min(m), max(m)) for m in hot)
    assert all((b - a).total_seconds() > 2 for (_, a), (b, _) in zip(spans, spans[1:]))
    inside = [sorted(m) for m in hot]
    assert all((b - a).total_seconds() < 4.1 for m in inside for a, b in zip(m, m[1:]))
    assert as_dict(A.token_bucket(df.withColumn("need", F.lit(1)), ["name"], 0.5, 1.0), "admitted") == brute_bucket(rows, 0.5, 1.0)


def test_token_bucket_cases(spark):
    rows = [("a", None, 0, 1.0), ("a", None, 1, 1.0), ("a", None, 2, 1.0), ("a", START, 3, 2.0), ("a", START, 4, None), ("a", START, 5, 3.0),
            (None, START, 6, 1.0), (None, START, 7, 2.0), ("a", START + dt.timedelta(days=9), 8, 2.0), (None, START, 9, 1.0)]
    df = spark.createDataFrame(rows, "name string, ts timestamp, seq bigint, need double")
    got = as_dict(A.token_bucket(df, ["name"], 1.0, 2.0), "admitted", "tokens_left", "wait_seconds")
    assert got == {0: (True, 1.0, 0.0), 1: (True, 0.0, 0.0), 2: (False, 0.0, 1.0), 3: (True, 0.0, 0.0), 4: (False, 0.0, None), 5: (False, 0.0, 3.0),
                   6: (True, 1.0, 0.0), 7: (False, 1.0, 1.0), 8: (True, 0.0, 0.0), 9: (True, 0.0, 0.0)}
    assert A.token_bucket(df.limit(0), ["name"], 1.0, 2.0).count() == 0


@pytest.mark.parametrize("per_chunk", [10_000, 80])
def test_breaches_and_cooldown(spark, series, per_chunk):
    rows, df = series
    limits = spark.createDataFrame([(n, 40.0, 80.0, 2) for n in ("hot", "a", "b", "c")],
                                   "name string, warning double, critical double, consecutive_failures int")
    runs = A.breach_runs(df, limits, rows_per_chunk=per_chunk)
    sent = A.cooldown(runs, cooldown_seconds=300, rows_per_chunk=per_chunk)
    run, last, want = {}, {}, {}
    for name, t, seq, value in rows:
        if value < 40:
            run[name], last[name] = 0, None
            want[seq] = (0, False)
            continue
        run[name] = run.get(name, 0) + 1
        ok = run[name] >= 2 and (last.get(name) is None or (t - last[name]).total_seconds() >= 300)
        if ok:
            last[name] = t
        want[seq] = (run[name], ok)
    assert as_dict(sent, "run", "alert") == want


def brute_health(rows):
    state, out = {}, {}
    for host, _, seq, status in rows:
        run, bad = state.get(host, (0, False))
        run = run + 1 if status == 502 else 0 if status is not None and 200 <= status < 300 else max(0, run - 1)
        state[host] = run, bad or run >= 3
        out[seq] = state[host]
    return out


@pytest.mark.parametrize("seconds", [1, 7, 60, 10**6])
def test_host_health(spark, seconds):
    codes = {"a": [502, 502, 200, 502, 502, 502], "b": [502, 502, 404, 502, 502]}
    rows = [(h, START + dt.timedelta(seconds=i), i + 10 * (h == "b"), s) for h, c in codes.items() for i, s in enumerate(c)]
    rng = random.Random(seconds)
    rows += [(rng.choice(["hot", "hot", "c", None]), START + dt.timedelta(seconds=i // 3), 100 + i, rng.choice([200, 204, 404, 502, 502, None, 300]))
             for i in range(500)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, seq bigint, status int")
    got = A.host_health(df, grid_micros=seconds * 1_000_000)
    assert got.columns == ["host", "ts", "seq", "status", "run_502", "unhealthy"]
    assert as_dict(got, "run_502", "unhealthy") == brute_health(rows)
    assert as_dict(got.filter("host = 'a'"), "run_502") == {i: (r,) for i, r in enumerate([1, 2, 0, 1, 2, 3])}


def test_no_python_and_no_job(spark, series):
    """Building starts no job; the health fold has no Python in its plan."""
    _, df = series
    log = df.select(F.col("name").alias("host"), "ts", "seq", F.lit(502).alias("status"))
    spark.sparkContext.setJobGroup("building", "building")
    health, admitted = A.host_health(log), A.token_bucket(df.withColumn("need", F.lit(1)), ["name"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = health._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and "Pandas" not in admitted._jdf.queryExecution().executedPlan().toString()


def test_hourly_limit(spark):
    at = [0, 10, 20, 30, 3600, 3601]
    df = spark.createDataFrame([("x", START + dt.timedelta(seconds=s), i) for i, s in enumerate(at)], "k string, ts timestamp, seq bigint")
    for n in (1000, 3):
        got = as_dict(A.hourly_limit(df, ["k"], rows_per_chunk=n), "recent", "allowed")
        assert got == {0: (0, True), 1: (1, True), 2: (2, True), 3: (3, False), 4: (3, False), 5: (4, False)}


@pytest.mark.parametrize("per_chunk", [1000, 4])
def test_unique_names(spark, per_chunk):
    names = ["a", "a_1", "a", "a", "b", "a_2", "a", "c.x"]
    taken = {"b", "a_3"}
    want, used = [], set(taken)
    for n in names:
        pick, i = n, 0
        while pick in used:
            i += 1
            pick = f"{n}_{i}"
        used.add(pick)
        want.append(pick)
    df = spark.createDataFrame(list(enumerate(names)), "seq bigint, name string")
    free = spark.createDataFrame([(x,) for x in taken], "name string")
    got = planning.unique_names(df, free, ["seq"], rows_per_chunk=per_chunk)
    assert [v[0] for _, v in sorted(as_dict(got, "unique_name").items())] == want
