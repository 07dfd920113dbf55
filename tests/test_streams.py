"""Streams give what their batch twins give, in one and in several micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crawlwright.operators import alerts as A
from crawlwright.operators import stats
from crawlwright.streaming import streams as R

START = dt.datetime(2024, 1, 1)
SCHEMA = "name string, host string, url string, ts timestamp, seq bigint, value double, status int, downloaded bigint, state string, need int"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, t = [], START
    for i in range(120):
        t += dt.timedelta(seconds=rng.choice([1, 5, 60, 200]))
        k = rng.choice("ab")
        rows.append((k, f"h{k}", f"u{k}", t, i, float(rng.randint(0, 100)), rng.choice([200, 404, 502, 502]), i * 100,
                     rng.choice(["downloading", "completed"]), 1))
    folder = str(tmp_path_factory.mktemp("stream"))
    for n in range(4):
        spark.createDataFrame(rows[n * 30:(n + 1) * 30], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(rows, SCHEMA)


def drain(spark, folder, tmp_path, build, batches, mode="append", name="out"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1 if batches > 1 else 100).parquet(folder)
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option(
        "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


@pytest.mark.parametrize("batches", [1, 4])
def test_folds(spark, source, tmp_path, batches):
    folder, batch = source
    pick = lambda rows, *c: sorted(tuple(r[x] for x in ("seq", *c)) for r in rows)
    got = drain(spark, folder, tmp_path, lambda s: R.rate_limit_stream(s, ["name"], 1 / 64, 2.0), batches, name=f"rate{batches}")
    assert pick(got, "admitted") == pick(A.token_bucket(batch, ["name"], 1 / 64, 2.0).collect(), "admitted")
    got = drain(spark, folder, tmp_path, R.host_health_stream, batches, name=f"host{batches}")
    assert pick(got, "run_502", "unhealthy") == pick(A.host_health(batch).collect(), "run_502", "unhealthy")
    rename = lambda df: df.drop("status").withColumnRenamed("state", "status")
    got = drain(spark, folder, tmp_path, lambda s: R.progress_stream(rename(s)), batches, name=f"prog{batches}")
    assert pick(got, "speed") == pick(stats.with_speed(rename(batch)).collect(), "speed")


@pytest.mark.parametrize("batches", [1, 4])
def test_alerts(spark, source, tmp_path, batches):
    folder, batch = source
    limits = spark.createDataFrame([("a", 40.0, 80.0, 2), ("b", 30.0, 60.0, 3)], "name string, warning double, critical double, consecutive_failures int")
    rules = spark.createDataFrame([(0, "r0", "a", ">", 0.0, "off", False), (1, "r1", "a", ">", 70.0, "rollback", True), (2, "r2", "a", ">", 10.0, "mail", True)],
                                  "pos int, rule_id string, metric_name string, condition string, threshold double, action string, enabled boolean")
    got = drain(spark, folder, tmp_path, lambda s: R.alert_stream(s, limits, rules), batches, name=f"alert{batches}")
    want = A.alert_events(batch, limits, rules).collect()
    key = lambda rows: sorted((r["seq"], r["severity"], r["action_taken"], r["threshold_value"]) for r in rows)
    assert key(got) == key(want) and len(got) > 3


def test_windows_and_counts(spark, source, tmp_path):
    folder, batch = source
    got = drain(spark, folder, tmp_path, lambda s: R.windowed_statistics(s, lateness="1 minute"), 4, "complete", "win")
    key = lambda rows: sorted((r["start"], r["name"], r["samples"], r["trend"]) for r in rows)
    assert key(got) == key(R.windowed_statistics(batch).collect())
    as_report = lambda df: df.select("ts", F.col("name").alias("level"), F.col("host").alias("exception_type"))
    got = drain(spark, folder, tmp_path, lambda s: R.error_stream(as_report(s)), 4, "complete", "err")
    assert sum(r["n"] for r in got) == 120
    health = lambda df: df.select("name", "ts", "seq", F.col("state").alias("status"))
    got = drain(spark, folder, tmp_path, lambda s: R.latest_health(health(s)), 4, "complete", "health")
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.latest_health(health(batch)).collect()))


def test_overall_health(spark):
    rows = [("a", START, 1, "critical"), ("a", START, 2, "warning"), ("b", START, 1, "healthy"), ("c", START, 1, "odd")]
    latest = R.latest_health(spark.createDataFrame(rows, "name string, ts timestamp, seq bigint, status string"))
    assert {r["name"]: r["status"] for r in latest.collect()} == {"a": "warning", "b": "healthy", "c": "odd"}
    assert R.overall_health(latest).first()["status"] == "warning"
    assert R.overall_health(latest.limit(0)).first()["status"] == "unknown"


def test_live_counts(spark, tmp_path):
    """Images per task and current status; an image that moves on is counted once."""
    schema = "task_id string, url string, ts timestamp, seq bigint, downloaded bigint, status string"
    rng, rows = random.Random(4), []
    for k in range(30):
        steps = ["pending", "downloading", "downloading", rng.choice(["completed", "failed", "paused"])][:rng.randint(1, 4)]
        rows += [(f"t{k % 3}", f"u{k}", START + dt.timedelta(seconds=10 * i + k), 0, i, s) for i, s in enumerate(steps)]
    rows.sort(key=lambda r: r[2])
    folder = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame(rows[n * len(rows) // 3:(n + 1) * len(rows) // 3], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = R.status_changes_stream(stream).writeStream.outputMode("append").format("memory").queryName("live").option(
        "checkpointLocation", str(tmp_path / "live")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = {}
    for task, url, *_, status in rows:
        want[task, url] = status
    counts = {}
    for (task, _), status in want.items():
        counts[task, status] = counts.get((task, status), 0) + 1
    assert {(r["task_id"], r["status"]): r["n"] for r in R.status_counts(spark.table("live")).collect()} == counts


def test_callbacks(spark, source, tmp_path):
    folder, _ = source
    seen, logged = [], []

    def broken(df, epoch):
        raise ValueError("no")
    run = R.callbacks(broken, lambda df, epoch: seen.append(df.count()), log=logged.append)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cb")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sum(seen) == 120 and len(logged) == len(seen)


def test_rows_of_a_key_in_parts(monkeypatch):
    """Rows come back in stable order, some at a time, with the values and types of one whole frame."""
    import numpy as np
    import pandas as pd

    from crawlwright.streaming import streams
    monkeypatch.setattr(streams, "ROWS_AT_ONCE", 7)
    rng = np.random.default_rng(3)

    def batch(n, flags, lists=False):
        return pd.DataFrame({
            "name": pd.Series([rng.choice(["a", "b", None]) for _ in range(n)], dtype=object), "flag": flags(n),
            "ts": pd.to_datetime(rng.integers(0, 5, n), unit="s"), "seq": rng.integers(0, 3, n), "n": np.arange(n, dtype="int32"),
            "value": np.where(np.arange(n) % 4 == 0, np.nan, rng.random(n)), "more": pd.Series([[1, 2]] * n if lists else ["x"] * n, dtype=object)})
    mixed = lambda n: pd.Series([True, None] * n, dtype=object)[:n]
    batches = [batch(9, lambda n: np.ones(n, dtype=bool)), batch(12, mixed), batch(5, mixed, lists=True)]
    held = streams._Rows()
    for b in batches:
        held.add(b)
    got = list(held.in_order(["ts", "seq"]))
    want = pd.concat(batches).sort_values(["ts", "seq"], kind="stable").reset_index(drop=True)
    assert [len(g) for g in got] == [7, 7, 7, 5]
    pd.testing.assert_frame_equal(pd.concat(got, ignore_index=True), want)
    assert all(list(g.index) == list(range(len(g))) and (g.dtypes == want.dtypes).all() for g in got)
