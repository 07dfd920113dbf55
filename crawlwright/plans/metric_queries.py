"""Queries over time series: metrics, errors, alerts, health, progress and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import progress as P
from ..operators import alerts, joins, stats
from ..sources import readers, writers
from . import derived as D
from .registry import Tables, query

NOW = "2024-01-31 00:00:00"
_NOW = f"TIMESTAMP '{NOW}'"


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# -------------------------------------------------------------------- metrics

def _stats_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS count, arg_max(value, seq) AS latest, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
  CASE WHEN count(*) > 1 THEN round(median(value), 6) END AS median, CASE WHEN count(*) > 1 THEN round(stddev_samp(value), 6) END AS stdev,
  CASE WHEN count(*) >= 10 THEN round(median(value), 6) END AS p50,
  CASE WHEN count(*) >= 10 THEN list_sort(list(value))[CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) + 1] END AS p90,
  CASE WHEN count(*) >= 10 THEN list_sort(list(value))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] END AS p95,
  CASE WHEN count(*) >= 10 THEN list_sort(list(value))[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] END AS p99
FROM {source} GROUP BY ALL"""


@query("A11", f"WITH {D.SAMPLES_SQL} {_stats_sql('samples', 'name')}")
def metric_statistics(t: Tables):
    return _rounded(stats.metric_statistics(D.samples(t)), "mean", "median", "stdev", "p50")


@query("A11", f"WITH {D.SAMPLES_SQL} {_stats_sql('samples', 'name, user_id')}")
def user_metric_statistics(t: Tables):
    return _rounded(stats.metric_statistics(D.samples(t), ["name", "user_id"]), "mean", "median", "stdev", "p50")


@query("A14 A17 A18 F32", f"""
WITH {D.SAMPLES_SQL}, x AS (SELECT *, arg_max(value, seq) OVER (PARTITION BY name) AS l FROM samples WHERE ts >= {_NOW} - INTERVAL 10080 MINUTE AND ts <= {_NOW}),
y AS (SELECT name, count(*) AS samples, arg_min(value, seq) AS first, arg_max(value, seq) AS current, min(value) AS min, max(value) AS max, round(avg(value), 6) AS average FROM x GROUP BY name)
SELECT *, CASE WHEN current > first THEN 'increasing' WHEN current < first THEN 'decreasing' ELSE 'stable' END AS trend,
  round(current - first, 6) AS growth, round((current - first) / samples, 8) AS growth_rate FROM y""")
def metric_trends(t: Tables):
    out = stats.metric_trends(stats.in_period(D.samples(t), NOW, 7 * 24 * 60))
    return _rounded(_rounded(out, "average", "growth"), "growth_rate", digits=8)


@query("W9", f"""
WITH {D.SAMPLES_SQL} SELECT name, seq, round(sum(value) OVER (PARTITION BY name ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 4) AS total FROM samples""")
def running_totals(t: Tables):
    return stats.running_totals(D.samples(t)).select("name", "seq", F.round("total", 4).alias("total"))


@query("A12 W8 W9", f"""
WITH {D.METRICS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM metrics WHERE metric_type = 'rate')
SELECT metric_type, name, round(sum(value), 4) AS current, NULL AS count, NULL AS mean, NULL AS min, NULL AS max, NULL AS median FROM metrics WHERE metric_type = 'counter' GROUP BY ALL
UNION ALL SELECT metric_type, name, round(arg_max(value, seq), 4), NULL, NULL, NULL, NULL, NULL FROM metrics WHERE metric_type = 'gauge' GROUP BY ALL
UNION ALL SELECT metric_type, name, NULL, count(*), round(avg(value), 6), min(value), max(value), round(median(value), 6) FROM metrics WHERE metric_type = 'timer' GROUP BY ALL
UNION ALL SELECT metric_type, name, round(arg_max(value, seq), 4), NULL, round(avg(value), 6), min(value), max(value), NULL FROM r WHERE rn <= 10 GROUP BY ALL""")
def metrics_snapshot(t: Tables):
    return _rounded(_rounded(stats.metrics_snapshot(D.metrics(t)), "mean", "median"), "current", digits=4)


@query("A13 F32", f"""
WITH {D.METRICS_SQL} SELECT metric_type, count(*) AS n FROM metrics WHERE ts BETWEEN {_NOW} - INTERVAL 24 HOUR AND {_NOW} GROUP BY metric_type""")
def period_type_counts(t: Tables):
    return stats.type_counts(D.metrics(t), NOW, 24 * 60)


@query("A20 W8 W7", f"""
WITH {D.METRICS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS rn FROM metrics)
SELECT name, count(*) AS calls, round(sum(value), 4) AS total_time, round(avg(value), 6) AS average_time, min(value) AS min_time, max(value) AS max_time,
  round(avg(value) FILTER (rn <= 10), 6) AS recent_average FROM r GROUP BY name""")
def timing_statistics(t: Tables):
    out = stats.timing_statistics(D.metrics(t))
    return _rounded(_rounded(out, "average_time", "recent_average"), "total_time", digits=4)


@query("T3", f"""
WITH {D.METRICS_SQL} SELECT name, count(*) AS calls, round(avg(value), 6) AS average_time FROM metrics GROUP BY name HAVING avg(value) > 50""")
def slow_functions(t: Tables):
    return _rounded(stats.slow_functions(stats.timing_statistics(D.metrics(t)), 50.0), "average_time").select("name", "calls", "average_time")


@query("W7", f"""
WITH {D.METRICS_SQL} SELECT name, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS rn FROM metrics) WHERE rn <= 100""")
def retained_history(t: Tables):
    return stats.last_rows(D.metrics(t), ["name"], ["ts", "seq"], 100).select("name", "seq", "value")


@query("K2", """
WITH h AS (SELECT date_trunc('hour', ts) AS ts, event_type AS name, value, event_id AS seq FROM events),
f AS (SELECT DISTINCT name FROM h WHERE ts = (SELECT min(ts) FROM h))
SELECT epoch_us(ts) AS instant, string_agg(concat(name, '=', printf('%.2f', v)), ' ' ORDER BY name) AS metrics
FROM (SELECT ts, name, arg_min(value, seq) AS v FROM h WHERE name IN (SELECT name FROM f) GROUP BY ALL) GROUP BY ts""")
def wide_metrics(t: Tables):
    """The wide table, folded into one text per hour to have fixed columns."""
    h = t.events.select(F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("name"), "value", F.col("event_id").alias("seq"))
    wide = writers.wide_metrics(h)
    names = sorted(c for c in wide.columns if c != "ts")
    cell = lambda n: F.when(F.col(n) != "", F.concat(F.lit(f"{n}="), F.format_string("%.2f", F.col(n).cast("double"))))
    return wide.select(F.unix_micros("ts").alias("instant"), F.concat_ws(" ", *[cell(n) for n in names]).alias("metrics")).filter("metrics <> ''")


@query("A19", """
WITH s AS (SELECT date_trunc('day', ts) AS ts, concat('u', CAST(user_id AS VARCHAR)) AS name, count(*) AS value FROM events GROUP BY ALL),
e AS (SELECT min(ts) AS a, max(ts) AS b FROM s)
SELECT name, coalesce(max(value) FILTER (ts = a), 0) AS first_count, max(value) FILTER (ts = b) AS last_count,
  max(value) FILTER (ts = b) - coalesce(max(value) FILTER (ts = a), 0) AS growth FROM s, e WHERE ts IN (a, b) GROUP BY name
HAVING max(value) FILTER (ts = b) - coalesce(max(value) FILTER (ts = a), 0) > 1""")
def grown_counters(t: Tables):
    s = t.events.groupBy(F.date_trunc("day", "ts").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")).agg(
        F.count("*").alias("value"))
    return stats.grown_counters(s, 1).select("name", "first_count", "last_count", "growth")


@query("A25 W7", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT count(*) AS requests, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS errors,
  round(avg(value) FILTER (rn <= 100), 6) AS average_time, min(value) FILTER (rn <= 100) AS min_time, max(value) FILTER (rn <= 100) AS max_time,
  round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM r""")
def parser_statistics(t: Tables):
    runs = t.events.select("ts", F.col("event_id").alias("seq"), F.col("value").alias("seconds"), (F.col("event_type") != "error").alias("success"))
    return _rounded(stats.parser_statistics(runs), "average_time", "success_rate")


# --------------------------------------------------------------------- errors

@query("A9 F32", f"""
WITH {D.REPORTS_SQL}
SELECT l AS level, count(r.level) AS n FROM (VALUES ('debug'), ('info'), ('warning'), ('error'), ('critical')) AS v(l)
LEFT JOIN reports r ON r.level = l AND ts >= {_NOW} - INTERVAL 72 HOUR AND ts <= {_NOW} GROUP BY l""")
def error_totals(t: Tables):
    return stats.error_totals(D.reports(t), NOW, 72)


@query("T2 A9", f"""
WITH {D.REPORTS_SQL}
SELECT exception_type, count(*) AS n FROM reports WHERE ts >= {_NOW} - INTERVAL 72 HOUR AND ts <= {_NOW} GROUP BY exception_type
ORDER BY n DESC, max(ts) DESC LIMIT 10""")
def top_error_types(t: Tables):
    return stats.top_error_types(D.reports(t), NOW, 72)


ERROR_TREND_SQL = f"""
WITH {D.REPORTS_SQL} SELECT epoch_us(date_trunc('hour', ts)) AS start, level, count(*) AS n FROM reports GROUP BY ALL"""


@query("A9", ERROR_TREND_SQL)
def error_trend(t: Tables):
    return stats.error_trend(D.reports(t)).withColumn("start", F.unix_micros("start"))


@query("T1 F31 V2", f"""
WITH {D.REPORTS_SQL}
SELECT seq, epoch_us(ts) AS at, level FROM reports WHERE level = 'error' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND user_id % 2 = 0 ORDER BY ts DESC, seq DESC LIMIT 50""")
def newest_reports(t: Tables):
    out = stats.newest(D.reports(t), 50, "error", "2024-01-10 00:00:00", predicates=[lambda df: df.user_id % 2 == 0])
    return out.select("seq", F.unix_micros("ts").alias("at"), "level")


@query("A10 F34", f"""
WITH {D.REPORTS_SQL}
SELECT exception_type, CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  count(*) AS errors, CAST(sum(user_id % 3) AS BIGINT) AS retries, count(*) FILTER (value > 20) AS recovered FROM reports GROUP BY ALL""")
def handler_statistics(t: Tables):
    classes = F.element_at(F.array(*[F.array(F.lit(c)) for c in ("MemoryError", "ConnectionError", "ValueError", "KeyError")]),
                           (F.col("user_id") % 4 + 1).cast("int"))
    x = D.reports(t).select("exception_type", P.error_severity(classes).alias("severity"), (F.col("user_id") % 3).alias("retries"),
                            (F.col("value") > 20).alias("recovered"))
    return stats.handler_statistics(x)


@query("U46 F34", f"""
WITH {D.REPORTS_SQL}
SELECT concat(CASE WHEN user_id % 5 = 0 THEN 'MSG_' ELSE 'ERR_' END, CAST(epoch_us(ts) // 1000000 AS VARCHAR), '_', lpad(CAST(row_number() OVER (ORDER BY seq) AS VARCHAR), 6, '0')) AS report_id,
  CASE WHEN user_id % 5 = 0 THEN 'info' ELSE 'error' END AS level, CASE WHEN user_id % 5 = 0 THEN 'Message' ELSE exception_type END AS exception_type, message,
  CAST(user_id AS VARCHAR) AS user_id FROM reports""")
def report_rows(t: Tables):
    own = F.col("user_id") % 5 != 0
    x = D.reports(t).select(
        "seq", "ts", F.lit(None).cast("string").alias("level"), F.when(own, F.col("exception_type")).alias("exception_type"), "message",
        F.array(F.lit("HTTPError"), F.lit("ConnectionError")).alias("class_names"),
        F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("context"))
    return stats.report_rows(x, ["seq"]).select("report_id", "level", "exception_type", "message", "user_id")


# log lines: the events of a user are the lines of that user's log
@query("S6", f"""
WITH {D.REPORTS_SQL} SELECT concat('r', seq) AS report_id, epoch_us(ts) // 1000 AS at, level, exception_type, message, seq FROM reports""")
def report_source(t: Tables):
    """Error reports written as JSON lines and read back."""
    rows = D.reports(t).select(F.concat(F.lit("r"), "seq").alias("report_id"), "ts", "level", "exception_type", "message", "seq")
    found = readers.reports(t.spark, D.written(rows, "json"))
    return found.select("report_id", F.unix_millis("ts").alias("at"), "level", "exception_type", "message", "seq")


@query("S7", f"WITH {D.SAMPLES_SQL} SELECT name, value, epoch_us(ts) AS at, seq FROM samples")
def sample_source(t: Tables):
    """Metric samples written as a table and read back; columns that the writer lacks are null."""
    found = readers.samples(t.spark, D.written(D.samples(t).drop("user_id"), "parquet"))
    return found.filter("unit IS NULL").select("name", "value", F.unix_micros("ts").alias("at"), "seq")


@query("S8", f"WITH {D.PROGRESS_SQL} SELECT url, epoch_us(ts) AS at, seq, downloaded, total, status FROM progress")
def progress_source(t: Tables):
    """The progress log written as a table and read back."""
    found = readers.progress(t.spark, D.written(D.progress(t).drop("task_id"), "parquet"))
    return found.select("url", F.unix_micros("ts").alias("at"), "seq", "downloaded", "total", "status")


@query("T9 A24 F33", """
WITH l AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn, event_type FROM events)
SELECT file, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) * 100, 6) AS error_rate FROM l WHERE rn <= 100 GROUP BY file""")
def log_error_rates(t: Tables):
    lines = t.events.select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.upper("event_type").alias("line"))
    return _rounded(stats.log_error_rate(lines), "error_rate")


@query("F33 T9", """
WITH l AS (SELECT user_id AS file, event_id AS line_no, event_type AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT file, line_no, line FROM l WHERE rn <= 5 AND regexp_matches(line, 'error|purchase')""")
def log_keyword_lines(t: Tables):
    lines = t.events.select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.col("event_type").alias("line"))
    return stats.keyword_lines(lines, ["error", "purchase"])


# --------------------------------------------------------------------- alerts

# the thresholds of a metric follow from its own mean
_LIMITS_SQL = """limits AS (SELECT event_type AS name, round(avg(value), 2) AS warning, round(avg(value) * 2, 2) AS critical, 2 AS need FROM events GROUP BY event_type)"""
_RUNS_SQL = f"""{D.SAMPLES_SQL}, {_LIMITS_SQL},
c AS (SELECT s.*, warning, critical, need, CASE WHEN value >= critical THEN 'critical' WHEN value >= warning THEN 'warning' ELSE 'normal' END AS severity FROM samples s JOIN limits USING (name)),
isl AS (SELECT *, sum((severity = 'normal')::INT) OVER (PARTITION BY name ORDER BY seq) AS island FROM c),
runs AS (SELECT *, count(*) FILTER (severity <> 'normal') OVER (PARTITION BY name, island ORDER BY seq) AS run FROM isl)"""


def metric_limits(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("name")).agg(
        F.round(F.avg("value"), 2).alias("warning"), F.round(F.avg("value") * 2, 2).alias("critical"), F.lit(2).alias("consecutive_failures"))


@query("W10 F35", f"""
WITH {_RUNS_SQL} SELECT name, seq, severity, run, severity <> 'normal' AND run >= need AS fires FROM runs""")
def alert_runs(t: Tables):
    return alerts.breach_runs(D.samples(t), metric_limits(t)).select("name", "seq", "severity", "run", "fires")


@query("J6", f"""
WITH {D.SAMPLES_SQL}, {_LIMITS_SQL}
SELECT name, seq, coalesce(warning, 0.0) AS warning, coalesce(critical, 0.0) AS critical FROM samples LEFT JOIN (SELECT * FROM limits WHERE name <> 'view') USING (name)""")
def sample_thresholds(t: Tables):
    """Limits of every sample's metric; one metric has none."""
    return joins.with_thresholds(D.samples(t), metric_limits(t).filter("name <> 'view'")).select("name", "seq", "warning", "critical")


ALERTS_SQL = f"""
WITH RECURSIVE {_RUNS_SQL},
f AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY name, island ORDER BY seq) AS k FROM runs WHERE severity <> 'normal' AND run >= need),
walk AS (
  SELECT name, island, k, seq, value, severity, us AS last, true AS alert FROM f WHERE k = 1
  UNION ALL
  SELECT f.name, f.island, f.k, f.seq, f.value, f.severity, CASE WHEN f.us - w.last >= 3600000000 THEN f.us ELSE w.last END, f.us - w.last >= 3600000000
  FROM walk w JOIN f ON f.name = w.name AND f.island = w.island AND f.k = w.k + 1)
SELECT name, seq, severity, CASE WHEN name = 'click' AND value > 100 THEN 'rollback' WHEN value > 60 THEN concat('notify_', name) ELSE '' END AS action_taken FROM walk WHERE alert"""


def alert_rules(t: Tables) -> DataFrame:
    """Three rules for every metric, the first of them disabled."""
    names = t.events.select(F.col("event_type").alias("metric_name")).distinct()
    rule = lambda pos, condition, threshold, action, enabled=True: F.struct(
        F.lit(pos).alias("pos"), F.lit(f"r{pos}").alias("rule_id"), F.lit(condition).alias("condition"), F.lit(threshold).alias("threshold"),
        action.alias("action"), F.lit(enabled).alias("enabled"))
    return names.select("metric_name", F.inline(F.array(
        rule(0, ">", 0.0, F.lit("never"), False), rule(1, ">", 100.0, F.when(F.col("metric_name") == "click", "rollback").otherwise(F.concat(F.lit("notify_"), "metric_name"))),
        rule(2, ">", 60.0, F.concat(F.lit("notify_"), "metric_name")))))


@query("W10 W11 J5 F30", ALERTS_SQL)
def alert_events(t: Tables):
    """Alerts with a cooldown of one hour and the action of the first rule that holds."""
    runs = alerts.breach_runs(D.samples(t), metric_limits(t))
    sent = alerts.cooldown(runs, cooldown_seconds=3600).filter("alert")
    out = alerts.first_matching_rule(alerts.as_events(sent), alert_rules(t))
    return out.select("name", "seq", "severity", "action_taken")


@query("W15", """
SELECT event_type, event_id, count(*) OVER w AS recent, count(*) OVER w < 3 AS allowed FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING)""")
def hourly_limit(t: Tables):
    e = t.events.select("event_type", "event_id", "ts")
    return alerts.hourly_limit(e, ["event_type"]).select("event_type", "event_id", "recent", "allowed")


@query("F37 J6 T8", f"""
WITH {D.SAMPLES_SQL}, {_LIMITS_SQL}, l AS (SELECT name, user_id, arg_max(value, seq) AS value FROM samples GROUP BY ALL)
SELECT concat(l.name, '_', CAST(user_id AS VARCHAR)) AS name, value, k.kind AS alert_type, CASE WHEN k.kind = 'soft_limit' THEN warning ELSE critical END AS threshold_value
FROM l JOIN limits USING (name), (VALUES ('soft_limit'), ('hard_limit')) AS k(kind) WHERE value > CASE WHEN k.kind = 'soft_limit' THEN warning ELSE critical END""")
def limit_alerts(t: Tables):
    name = F.concat("name", F.lit("_"), F.col("user_id").cast("string"))
    s = D.samples(t)
    limits = s.select("name", "user_id").distinct().join(metric_limits(t), "name").select(
        name.alias("name"), F.col("warning").alias("soft_limit"), F.col("critical").alias("hard_limit"), F.lit(True).alias("enabled"))
    return alerts.limit_alerts(s.withColumn("name", name), limits).select("name", "value", "alert_type", "threshold_value")


@query("F36", f"""
WITH {D.SAMPLES_SQL}, {_LIMITS_SQL}
SELECT name, seq, 'max' AS kind FROM samples JOIN limits USING (name) WHERE value > critical
UNION ALL SELECT name, seq, 'min' FROM samples JOIN limits USING (name) WHERE value < round(warning / 10, 2)""")
def bound_alerts(t: Tables):
    lim = metric_limits(t)
    bounds = lim.select("name", F.inline(F.array(
        F.struct(F.lit("max").alias("kind"), F.col("critical").alias("threshold")),
        F.struct(F.lit("min").alias("kind"), F.round(F.col("warning") / 10, 2).alias("threshold")))))
    return alerts.bound_alerts(D.samples(t), bounds).select("name", "seq", "kind")


@query("F42", f"""
WITH {_LIMITS_SQL}, r AS (SELECT event_type AS name, event_id, value AS current, CAST(user_id AS DOUBLE) AS required FROM events)
SELECT event_id, name = 'view' OR current + required <= critical AS available, CASE WHEN name = 'view' THEN 'inf' ELSE CAST(round(greatest(0, critical - current), 2) >= 50 AS VARCHAR) END AS room
FROM r JOIN limits USING (name)""")
def capacity_check(t: Tables):
    lim = metric_limits(t).filter("name <> 'view'").select("name", F.col("critical").alias("max_value"), F.lit(True).alias("enabled"))
    r = t.events.select(F.col("event_type").alias("name"), "event_id", F.col("value").alias("current"), F.col("user_id").cast("double").alias("required"))
    room = F.when(F.col("headroom") == float("inf"), "inf").otherwise((F.round("headroom", 2) >= 50).cast("string"))
    return alerts.capacity_check(r, lim).select("event_id", "available", room.alias("room"))


_HEALTH_SQL = f"""{D.SAMPLES_SQL}, {_LIMITS_SQL},
st AS (SELECT date_trunc('hour', ts) AS ts, CASE WHEN name = 'view' THEN 0 WHEN value >= critical THEN 3 WHEN value >= warning THEN 2 ELSE 1 END AS r FROM samples JOIN limits USING (name)),
health AS (SELECT ts, max(r) AS r, count(*) FILTER (r >= 2) AS alerts FROM st GROUP BY ts)"""


def _health(t: Tables) -> DataFrame:
    lim = metric_limits(t).withColumn("critical", F.when(F.col("name") != "view", F.col("critical")))
    rows = D.samples(t).join(lim, "name")
    return stats.health_rollup(rows.select(F.date_trunc("hour", "ts").alias("ts"), P.threshold_status("value", "warning", "critical").alias("status")))


@query("A15 F35", f"""
WITH {_HEALTH_SQL} SELECT epoch_us(ts) AS at, ['unknown', 'healthy', 'warning', 'critical'][r + 1] AS overall_status, alerts FROM health""")
def health_rollup(t: Tables):
    return _health(t).select(F.unix_micros("ts").alias("at"), "overall_status", "alerts")


@query("A16", f"""
WITH {_HEALTH_SQL}, n AS (SELECT ['unknown', 'healthy', 'warning', 'critical'][r + 1] AS s, ts FROM health)
SELECT v.s AS overall_status, count(n.s) AS n, (SELECT count(*) FROM n) AS total_checks, (SELECT arg_max(s, ts) FROM n) AS latest_status,
  round(count(n.s) * 100.0 / (SELECT count(*) FROM n), 6) AS percent FROM (VALUES ('unknown'), ('healthy'), ('warning'), ('critical')) AS v(s) LEFT JOIN n ON n.s = v.s GROUP BY v.s""")
def health_statistics(t: Tables):
    return _rounded(stats.health_statistics(_health(t)), "percent")


@query("F35 A28", """
SELECT event_id, CASE WHEN value > 90 OR m > 90 THEN 'CRITICAL' WHEN value > 70 OR m > 70 THEN 'WARNING' WHEN value > 50 OR m > 50 THEN 'MODERATE' ELSE 'HEALTHY' END AS load,
  CASE WHEN value > 90 OR m > 95 OR d > 95 THEN 'critical' WHEN value > 80 OR m > 85 OR d > 85 THEN 'warning' ELSE 'healthy' END AS resources,
  CAST(CASE event_id % 3 WHEN 0 THEN CASE WHEN value < 50 AND m < 70 THEN 16 WHEN value < 70 AND m < 80 THEN 8 ELSE 4 END
    WHEN 1 THEN CASE WHEN value < 60 AND m < 70 THEN 4 WHEN value < 80 AND m < 85 THEN 2 ELSE 1 END
    ELSE CASE WHEN value < 50 AND m < 60 THEN 8 WHEN value < 70 AND m < 80 THEN 4 ELSE 2 END END AS BIGINT) AS workers
FROM (SELECT *, CAST(user_id % 100 AS DOUBLE) AS m, CAST(event_id % 98 AS DOUBLE) AS d FROM events)""")
def load_status(t: Tables):
    e = t.events.select("event_id", "value", (F.col("user_id") % 100).cast("double").alias("m"), (F.col("event_id") % 98).cast("double").alias("d"),
                        F.element_at(F.array(*map(F.lit, ["download", "parse", "process"])), (F.col("event_id") % 3 + 1).cast("int")).alias("task_type"))
    return e.select("event_id", P.load_status("value", "m").alias("load"), P.resource_status("value", "m", "d").alias("resources"),
                    stats.task_width("task_type", "value", "m", 4).cast("bigint").alias("workers"))


# -------------------------------------------------------------------- progress

DOWNLOAD_SPEED_SQL = f"""
WITH {D.PROGRESS_SQL}
SELECT url, seq, round(coalesce((downloaded - lag(downloaded) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6), 0), 6) AS speed FROM progress WINDOW w AS (PARTITION BY url ORDER BY ts, seq)"""


@query("W4", DOWNLOAD_SPEED_SQL)
def download_speed(t: Tables):
    return stats.with_speed(D.progress(t)).select("url", "seq", F.round("speed", 6).alias("speed"))


@query("W6", f"""
WITH {D.PROGRESS_SQL}
SELECT url, seq, old_status, status FROM (SELECT *, lag(status) OVER (PARTITION BY url ORDER BY ts, seq) AS old_status FROM progress) WHERE old_status IS DISTINCT FROM status""")
def status_transitions(t: Tables):
    return stats.status_transitions(D.progress(t)).select("url", "seq", "old_status", "status")


@query("W5 J8 T8 W4", f"""
WITH {D.PROGRESS_SQL}, s AS (SELECT *, coalesce((downloaded - lag(downloaded) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6), 0) AS speed FROM progress WINDOW w AS (PARTITION BY url ORDER BY ts, seq)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, seq DESC) AS rn FROM s) WHERE rn = 1)
SELECT task_id, count(*) AS total_files, count(*) FILTER (status = 'completed') AS completed_files, count(*) FILTER (status = 'failed') AS failed_files,
  CAST(sum(downloaded) AS BIGINT) AS downloaded_bytes, CAST(sum(total) AS BIGINT) AS total_bytes, round(coalesce(sum(speed) FILTER (speed > 0), 0), 6) AS current_speed
FROM l GROUP BY task_id""")
def task_progress(t: Tables):
    p = D.progress(t)
    latest = joins.latest_progress(stats.with_speed(p).select("url", "ts", "seq", "downloaded", "total", "speed", "status"))
    images = p.select("url", "task_id").distinct().withColumn("status", F.lit("pending"))
    out = stats.task_progress(joins.overlay_progress(images, latest))
    return _rounded(out, "current_speed").drop("eta_seconds")


@query("W6 T8", f"""
WITH {D.PROGRESS_SQL} SELECT url, arg_max(status, seq) AS status FROM progress GROUP BY url""")
def current_status(t: Tables):
    return stats.current_status(D.progress(t))


@query("R2", """
WITH w AS (SELECT event_type AS name, value, ts, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start FROM events, generate_series(0, 1) AS g(k))
SELECT epoch_us(start) AS start, name, count(*) AS samples, round(avg(value), 6) AS average, min(value) AS min, max(value) AS max,
  CASE WHEN arg_max(value, ts) > arg_min(value, ts) THEN 'increasing' WHEN arg_max(value, ts) < arg_min(value, ts) THEN 'decreasing' ELSE 'stable' END AS trend FROM w GROUP BY start, name""")
def windowed_statistics(t: Tables):
    """The streaming definition run over the whole table: 60-minute windows every 30 minutes."""
    from ..streaming import streams
    out = streams.windowed_statistics(D.samples(t), "60 minutes", "30 minutes")
    return _rounded(out, "average").select(F.unix_micros("start").alias("start"), "name", "samples", "average", "min", "max", "trend")


@query("R3 T8", f"""
WITH {D.LOG_SQL} SELECT host AS name, epoch_us(max(ts)) AS at, last(status ORDER BY ts, seq) = 200 AS healthy FROM log GROUP BY host""")
def latest_health(t: Tables):
    from ..streaming import streams
    s = D.request_log(t).select(F.col("host").alias("name"), "ts", "seq", F.when(F.col("status") == 200, "healthy").otherwise("critical").alias("status"))
    return streams.latest_health(s).select("name", F.unix_micros("ts").alias("at"), (F.col("status") == "healthy").alias("healthy"))


@query("K6 W7 T1", """
SELECT event_id, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def kept_events(t: Tables):
    return writers.kept_events(t.events).select("event_id", F.unix_micros("ts").alias("at"))
