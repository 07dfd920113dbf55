"""Operational statistics: downloads, tasks, errors, metrics, resources, timings, hosts.

Counts and sums aggregate partially on the map side, so a hot key costs one
row per task. Order statistics and the last n rows of a key go through
``ordered``, which never puts a whole key into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import images as I
from ..functions import progress as P
from . import ordered as O
from .dedupe import keep_last

# Levels, states, limits and advice texts.
REPORT_LEVELS = ["debug", "info", "warning", "error", "critical"]
ISSUE_LEVELS = ["low", "medium", "high", "critical"]
HEALTH_STATES = ["healthy", "warning", "critical", "unknown"]
HIGH_SCORE, MEDIUM_SCORE = 0.8, 0.5
PERCENTILES = {"p90": 0.90, "p95": 0.95, "p99": 0.99}
PERCENTILES_FROM = 10
GROWTH_THRESHOLD = 100
IMAGE_FILE_EXTS = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp"]
HOT_ADVICE = {
    "calls": "考虑减少函数调用次数或使用缓存", "slow": "函数执行时间较长，考虑算法优化",
    "io": "I/O操作较多，考虑批量处理或异步操作", "network": "网络操作较多，考虑连接池或并发处理",
    "none": "暂无特定建议",
}
HOST_ADVICE = {
    "errors": "检测到大量502错误，建议降低下载速度或更换下载时间", "success": "成功率较低，建议检查网络连接或服务器状态",
    "slow": "服务器响应较慢，建议增加超时时间或降低并发数", "unhealthy": "服务器状态不佳，系统已启用保护模式",
}
NO_IMAGES = "目录中没有图片文件"


def _micros(ts) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def _latest(value: str, order: list[str]) -> Column:
    return F.max_by(value, F.struct(*order))


def _oldest(value: str, order: list[str]) -> Column:
    return F.min_by(value, F.struct(*order))


def zero_filled(counts: DataFrame, column: str, values: list[str], count: str = "n") -> DataFrame:
    """One row for every listed value; those without rows get 0."""
    spark = counts.sparkSession
    listed = spark.range(len(values)).select(F.element_at(F.array(*map(F.lit, values)), (F.col("id") + 1).cast("int")).alias(column))
    return listed.join(counts, column, "left").withColumn(count, F.coalesce(count, F.lit(0)))


# ------------------------------------------------------------------ retention

def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int, value: Column | None = None) -> DataFrame:
    """The last n rows per key; n <= 0 keeps all.

    Spark cuts a ranking with a limit inside every input task first, so at
    most n rows per key and task are shuffled.
    """
    if n <= 0:
        return df
    desc = [F.col(c).desc() for c in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*desc))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def newest_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows of all; n <= 0 keeps all."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n) if n > 0 else df


def in_period(df: DataFrame, now, minutes: float, ts: str = "ts", strict: bool = False) -> DataFrame:
    """F32: rows of the last minutes before an explicit now; strict leaves out the oldest instant."""
    end = F.lit(now).cast("timestamp")
    start = F.timestamp_micros(F.unix_micros(end) - int(minutes * 60_000_000))
    after = (F.col(ts) > start) if strict else (F.col(ts) >= start)
    return df.filter(after & (F.col(ts) <= end))


def cleared(df: DataFrame, before, ts: str = "ts") -> DataFrame:
    """F32: what a clear-before leaves."""
    return df.filter(F.col(ts) >= F.lit(before).cast("timestamp"))


# ----------------------------------------------------------------- images

def filter_statistics(images: DataFrame) -> DataFrame:
    """A1: totals and quality classes over the output of the image rules (``passed, reasons, score``)."""
    s = F.col("score")
    return images.agg(
        F.count("*").alias("total_images"), F.count_if("passed").alias("passed_images"),
        F.count_if(~F.col("passed")).alias("failed_images"),
        F.count_if(s >= HIGH_SCORE).alias("high"),
        F.count_if((s >= MEDIUM_SCORE) & (s < HIGH_SCORE)).alias("medium"),
        F.count_if(s < MEDIUM_SCORE).alias("low"))


def reason_counts(images: DataFrame) -> DataFrame:
    """A1: how often each reason was given."""
    return images.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ tasks

def validation_statistics(results: DataFrame) -> DataFrame:
    """A2 and A3: counts over validated tasks, and the share of valid ones (0 to 1)."""
    dup = F.col("directory_exists") | F.col("task_exists")
    return results.agg(
        F.count("*").alias("total"), F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if(dup).alias("duplicate"),
        F.count_if(~F.col("network_accessible")).alias("network_issues"),
        F.count_if(~F.col("has_images")).alias("no_images"),
        F.count_if(~F.col("is_valid") & dup).alias("duplicate_skipped"),
        F.count_if(~F.col("is_valid") & ~dup).alias("failed_analysis")).withColumn(
        "validation_rate", F.coalesce(F.try_divide("valid", "total"), F.lit(0.0)))


def failed_pages(results: DataFrame) -> DataFrame:
    """A3: the urls that failed without being duplicates."""
    return results.filter("not is_valid and not directory_exists and not task_exists").select("url")


def task_statistics(tasks: DataFrame) -> DataFrame:
    """A4: tasks and image counters per status."""
    return tasks.groupBy("status").agg(
        F.count("*").alias("tasks"), F.sum("total_images").alias("total_images"),
        F.sum("downloaded_images").alias("downloaded_images"), F.sum("failed_images").alias("failed_images"))


def image_status_counts(images: DataFrame, task: str = "task_id") -> DataFrame:
    """A5: completed, downloading, failed and, for everything else, pending images per task."""
    known = ["completed", "downloading", "failed"]
    s = F.col("status")
    return images.groupBy(task).agg(
        F.count("*").alias("total"), *[F.count_if(s == k).alias(k) for k in known],
        F.count_if(~F.coalesce(s.isin(known), F.lit(False))).alias("pending"))


def download_statistics(attempts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counters of an attempt log ``(outcome, retries, status, bytes, seconds)``."""
    o = F.col("outcome")
    zero = lambda c: F.coalesce(c, F.lit(0))
    aggs = [
        F.count("*").alias("total"), F.count_if(o == "success").alias("success"),
        F.count_if(o == "failed").alias("failed"), F.count_if(o == "skipped").alias("skipped"),
        zero(F.sum("retries")).alias("retry"), F.count_if(F.col("status") >= 500).alias("server_errors"),
        zero(F.sum("bytes")).alias("bytes_downloaded"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")]
    out = attempts.groupBy(*keys).agg(*aggs) if keys else attempts.agg(*aggs)
    done = F.col("success") + F.col("failed") + F.col("skipped")
    return (out.withColumn("in_progress", done < F.col("total"))
            .withColumn("speed", F.coalesce(F.try_divide(F.col("bytes_downloaded").cast("double"), F.col("seconds")), F.lit(0.0)))
            .withColumn("success_rate", F.col("success") * 100.0 / F.greatest("total", F.lit(1))).drop("seconds"))


def task_outcomes(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Completed when the task's directory holds an image file, else failed with a message."""
    is_image = F.lower("filename").rlike("(" + "|".join(e.replace(".", r"\.") for e in IMAGE_FILE_EXTS) + ")$")
    have = files.filter(is_image).groupBy("dir").agg(F.count("*").alias("image_files"))
    out = tasks.join(have, "dir", "left").withColumn("image_files", F.coalesce("image_files", F.lit(0)))
    ok = F.col("image_files") > 0
    return (out.withColumn("status", F.when(ok, "completed").otherwise("failed"))
            .withColumn("error_message", F.when(~ok, NO_IMAGES)))


# ------------------------------------------------------------------ files

def directory_statistics(files: DataFrame) -> DataFrame:
    """Files, bytes and the largest file of every directory; the first of equals."""
    return files.groupBy("dir").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"),
        F.min_by("filename", F.struct(-F.col("length"), F.col("filename"))).alias("largest_file"),
        F.max("length").alias("largest_size"))


def extension_statistics(files: DataFrame) -> DataFrame:
    """Files and bytes per directory and extension."""
    ext = F.lower(F.regexp_extract("filename", r"(?<=[^.])(\.[^.]+)$", 1))
    return files.groupBy("dir", ext.alias("ext")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def files_by_type(files: DataFrame) -> DataFrame:
    """Files with their type, ready to be written partitioned by it; files without one are left out.

    A list per type would be one unbounded row, so the grouping is the
    partition column (``write.partitionBy('ext')``).
    """
    ext = F.lower(F.regexp_extract("filename", r"(?<=[^.])\.([^.]+)$", 1))
    return files.withColumn("ext", ext).filter("ext <> ''")


# ----------------------------------------------------------------- errors

def error_totals(reports: DataFrame, now, hours: float = 24) -> DataFrame:
    """Reports of the last hours per level; every level has a row."""
    recent = in_period(reports, now, hours * 60)
    return zero_filled(recent.groupBy("level").agg(F.count("*").alias("n")), "level", REPORT_LEVELS)


def top_error_types(reports: DataFrame, now, hours: float = 24, k: int = 10) -> DataFrame:
    """The k most frequent types; on ties the one whose newest report is younger comes first."""
    recent = in_period(reports, now, hours * 60)
    return (recent.groupBy("exception_type").agg(F.count("*").alias("n"), F.max(F.struct("ts", "seq")).alias("_new"))
            .orderBy(F.col("n").desc(), F.col("_new").desc()).limit(k).drop("_new"))


def error_trend(reports: DataFrame, width: str = "1 hour") -> DataFrame:
    """Reports per level and hour."""
    return reports.groupBy(F.window("ts", width).alias("_w"), "level").agg(F.count("*").alias("n")).select(
        F.col("_w.start").alias("start"), "level", "n")


def handler_statistics(errors: DataFrame) -> DataFrame:
    """A10: errors per type and severity with retries and recoveries."""
    return errors.groupBy("exception_type", "severity").agg(
        F.count("*").alias("errors"), F.sum("retries").alias("retries"), F.count_if("recovered").alias("recovered"))


def newest(reports: DataFrame, limit: int | None = None, level: str | None = None, start=None, end=None,
           predicates: list = ()) -> DataFrame:
    """Reports newest first; a predicate is a function of the frame that gives a Column.

    A predicate that cannot be evaluated for a row (null) lets the row pass.
    """
    out = reports
    if level is not None:
        out = out.filter(F.col("level") == level)
    if start is not None:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    for p in predicates:
        out = out.filter(F.coalesce(p(out), F.lit(True)))
    out = out.orderBy(F.col("ts").desc(), F.col("seq").desc())
    return out.limit(limit) if limit is not None else out


def by_id(rows: DataFrame, column: str, value) -> DataFrame:
    """the row with an id, or none."""
    return rows.filter(F.col(column) == value).limit(1)


def report_rows(errors: DataFrame, order: list[str], rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """Error reports with an id of kind, epoch seconds and a six-digit running number.

    The running number is global; it comes from chunk counts, not from one
    ordered partition.
    """
    numbered = O.numbered(errors.withColumn("_all", F.lit(0)), ["_all"], order, "_no", rows_per_chunk)
    is_error = F.col("exception_type").isNotNull()
    level = F.coalesce("level", F.when(is_error, P.error_level("class_names")).otherwise("info"))
    return numbered.select(
        F.concat(F.when(is_error, "ERR_").otherwise("MSG_"), F.unix_seconds("ts").cast("string"), F.lit("_"),
                 F.lpad(F.col("_no").cast("string"), 6, "0")).alias("report_id"),
        "ts", level.alias("level"), F.coalesce("exception_type", F.lit("Message")).alias("exception_type"), "message",
        "context", F.try_element_at("context", F.lit("user_id")).alias("user_id"),
        F.try_element_at("context", F.lit("session_id")).alias("session_id"))


# ---------------------------------------------------------------- metrics

def metric_statistics(samples: DataFrame, keys: list[str] = ("name",), order: list[str] = ("ts", "seq"),
                      rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """Count, latest, min, max, mean; from 2 rows on median and sample deviation, from 10 on percentiles.

    A percentile is the value at position int(n * q) of the sorted values.
    """
    keys, order = list(keys), list(order)
    basic = samples.groupBy(*keys).agg(
        F.count("value").alias("count"), _latest("value", order).alias("latest"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"))
    at = lambda n: {"_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2), "_p50": F.floor(n / 2),
                    **{k: F.floor(n * q) for k, q in PERCENTILES.items()}}
    ranks = O.order_statistics(samples, keys, "value", at, rows_per_chunk)
    rows = O.join_on_keys(basic, ranks, keys)
    median = (F.col("_lo") + F.col("_hi")) / 2
    many = F.col("count") >= PERCENTILES_FROM
    return rows.select(
        *keys, "count", "latest", "min", "max", "mean", F.when(F.col("count") > 1, median).alias("median"),
        F.when(F.col("count") > 1, F.col("stdev")).alias("stdev"), F.when(many, median).alias("p50"),
        *[F.when(many, F.col(p)).alias(p) for p in PERCENTILES])


def metric_trends(samples: DataFrame, keys: list[str] = ("name",), order: list[str] = ("ts", "seq")) -> DataFrame:
    """First, current, min, max, average, growth per sample and trend per key."""
    order = list(order)
    out = samples.groupBy(*keys).agg(
        F.count("*").alias("samples"), _oldest("value", order).alias("first"), _latest("value", order).alias("current"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("average"))
    growth = F.col("current") - F.col("first")
    return (out.withColumn("trend", F.when(growth > 0, "increasing").when(growth < 0, "decreasing").otherwise("stable"))
            .withColumn("growth", growth)
            .withColumn("growth_rate", F.when(F.col("samples") > 1, growth / F.col("samples")).otherwise(0.0)))


def running_totals(samples: DataFrame, keys: list[str] = ("name",), order: list[str] = ("ts", "seq"),
                   rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """The counter's total after each sample."""
    return O.running(samples, list(keys), list(order), {"total": O.Running("sum", F.col("value"))}, rows_per_chunk)


def metrics_snapshot(samples: DataFrame, order: list[str] = ("ts", "seq"), recent: int = 10,
                     rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """Counters by total, gauges by last value, timers over all, rates over the last ten samples."""
    order, keys = list(order), ["metric_type", "name"]
    counters = samples.filter("metric_type = 'counter'").groupBy(*keys).agg(F.sum("value").alias("current"))
    gauges = samples.filter("metric_type = 'gauge'").groupBy(*keys).agg(_latest("value", order).alias("current"))
    timers = metric_statistics(samples.filter("metric_type = 'timer'"), keys, order, rows_per_chunk).select(
        *keys, "count", "mean", "min", "max", "median")
    rates = last_rows(samples.filter("metric_type = 'rate'"), keys, order, recent).groupBy(*keys).agg(
        _latest("value", order).alias("current"), F.avg("value").alias("mean"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    out = counters
    for part in (gauges, timers, rates):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def type_counts(samples: DataFrame, now, minutes: float = 60) -> DataFrame:
    """Samples of the period per metric type."""
    return in_period(samples, now, minutes).groupBy("metric_type").agg(F.count("*").alias("n"))


def moving_average(samples: DataFrame, keys: list[str], order: list[str] = ("ts", "seq"), n: int = 10) -> DataFrame:
    """Mean of the last n values of each key."""
    return last_rows(samples, keys, list(order), n).groupBy(*keys).agg(F.avg("value").alias("recent_average"))


def timing_statistics(timings: DataFrame, key: str = "name", order: list[str] = ("ts", "seq")) -> DataFrame:
    """Calls, total, average, min and max per function, and the average of its last ten calls."""
    basic = timings.groupBy(key).agg(
        F.count("*").alias("calls"), F.sum("value").alias("total_time"), F.avg("value").alias("average_time"),
        F.min("value").alias("min_time"), F.max("value").alias("max_time"))
    return basic.join(moving_average(timings, [key], order), key)


def slow_functions(stats: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Functions slower than the threshold on average, slowest first."""
    return stats.filter(F.col("average_time") > threshold).orderBy(F.col("average_time").desc(), "name")


def hot_spots(stats: DataFrame, k: int = 10, io: Column | None = None, network: Column | None = None) -> DataFrame:
    """The k functions with most time, their share of all time and the advice for them.

    ``stats(name, calls, total_time)``; the total is joined as one row, not
    taken from a window without a key.
    """
    total = stats.agg(F.sum("total_time").alias("_all"))
    top = stats.orderBy(F.col("total_time").desc(), "name").limit(k)
    per_call = F.col("total_time") / F.col("calls")
    file_like = io if io is not None else F.lower("name").contains("file")
    net_like = network if network is not None else F.lower("name").contains("request")
    advice = F.concat_ws("; ", F.when(F.col("calls") > 10000, HOT_ADVICE["calls"]),
                         F.when(per_call > 0.1, HOT_ADVICE["slow"]), F.when(file_like, HOT_ADVICE["io"]),
                         F.when(net_like, HOT_ADVICE["network"]))
    share = F.when(F.col("_all") > 0, F.col("total_time") / F.col("_all") * 100).otherwise(0.0)
    return (top.join(F.broadcast(total)).withColumn("average_time", per_call).withColumn("percentage", share)
            .withColumn("advice", F.when(advice == "", HOT_ADVICE["none"]).otherwise(advice)).drop("_all"))


def effect_statistics(changes: DataFrame) -> DataFrame:
    """Per type how many changes succeeded and what they saved; ``changes(type, before, after, success)``."""
    saved = F.col("before") - F.col("after")
    return changes.groupBy("type").agg(
        F.count("*").alias("total"), F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), saved)), F.lit(0.0)).alias("saved")).withColumn(
        "success_rate", F.col("successful") / F.col("total") * 100)


def with_improvement(changes: DataFrame) -> DataFrame:
    """Difference and percent of each change."""
    saved = F.col("before") - F.col("after")
    return changes.withColumn("saved", saved).withColumn(
        "saved_percent", F.when(F.col("before") > 0, saved / F.col("before") * 100).otherwise(0.0))


def grown_counters(snapshots: DataFrame, threshold: float = GROWTH_THRESHOLD) -> DataFrame:
    """Counters that rose by more than the threshold between the first and the last snapshot.

    ``snapshots(ts, name, value)``; a counter the first one lacks started at 0.
    """
    ends = F.broadcast(snapshots.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")))
    rows = snapshots.join(ends, (F.col("ts") == F.col("first_seen")) | (F.col("ts") == F.col("last_seen")))
    out = rows.groupBy("name", "first_seen", "last_seen").agg(
        F.coalesce(F.max(F.when(F.col("ts") == F.col("first_seen"), F.col("value"))), F.lit(0)).alias("first_count"),
        F.max(F.when(F.col("ts") == F.col("last_seen"), F.col("value"))).alias("last_count"))
    grown = F.col("last_count") - F.col("first_count")
    return out.filter(grown > threshold).withColumn("growth", grown)


# ------------------------------------------------------------------ health

def health_rollup(statuses: DataFrame) -> DataFrame:
    """Overall status per instant is the worst of its metrics."""
    rank = F.array_position(F.array(*map(F.lit, ["unknown", "healthy", "warning", "critical"])), F.col("status"))
    out = statuses.groupBy("ts").agg(F.max(rank).alias("_r"), F.count_if(F.col("status").isin("warning", "critical")).alias("alerts"))
    return out.select("ts", F.element_at(F.array(*map(F.lit, ["unknown", "healthy", "warning", "critical"])),
                                         F.col("_r").cast("int")).alias("overall_status"), "alerts")


def health_statistics(health: DataFrame) -> DataFrame:
    """Checks per overall status with zeros, their percent, and the latest status."""
    total = health.agg(F.count("*").alias("total_checks"), F.max_by("overall_status", "ts").alias("latest_status"))
    counts = zero_filled(health.groupBy("overall_status").agg(F.count("*").alias("n")), "overall_status", HEALTH_STATES)
    return counts.join(F.broadcast(total)).withColumn(
        "percent", F.coalesce(F.try_divide(F.col("n") * 100.0, "total_checks"), F.lit(0.0)))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues per level with zeros, and per category title."""
    levels = zero_filled(issues.groupBy("level").agg(F.count("*").alias("n")), "level", ISSUE_LEVELS).select(
        F.lit("level").alias("kind"), F.col("level").alias("value"), "n")
    cats = issues.groupBy(F.split("title", ":")[0].alias("value")).agg(F.count("*").alias("n")).select(
        F.lit("category").alias("kind"), "value", "n")
    return levels.unionByName(cats)


def log_error_rate(lines: DataFrame, n: int = 100, keys: list[str] = ("file",)) -> DataFrame:
    """Percent of the last n lines of a file that contain ERROR."""
    tail = last_rows(lines, list(keys), ["line_no"], n)
    return tail.groupBy(*keys).agg((F.avg(F.col("line").contains("ERROR").cast("double")) * 100).alias("error_rate"))


def keyword_lines(lines: DataFrame, words: list[str], n: int = 5, keys: list[str] = ("file",)) -> DataFrame:
    """of the last n lines of a file those with any of the words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("line").contains(w)
    return last_rows(lines, list(keys), ["line_no"], n).filter(hit)


def parser_statistics(runs: DataFrame, n: int = 100, order: list[str] = ("ts", "seq")) -> DataFrame:
    """Requests, successes and their rate, and times over the last n runs."""
    totals = runs.agg(F.count("*").alias("requests"), F.count_if("success").alias("successes"),
                      F.count_if(~F.col("success")).alias("errors"))
    recent = newest_rows(runs, list(order), n).agg(
        F.avg("seconds").alias("average_time"), F.min("seconds").alias("min_time"), F.max("seconds").alias("max_time"))
    return totals.join(F.broadcast(recent)).withColumn(
        "success_rate", F.coalesce(F.try_divide("successes", "requests"), F.lit(0.0)))


def crawl_statistics(found: DataFrame) -> DataFrame:
    """Per base url the sub-pages and images found and how many are valid; ``found(base_url, kind, valid)``."""
    count = lambda k, extra=None: F.count_if((F.col("kind") == k) & (F.lit(True) if extra is None else extra))
    ok = F.coalesce(F.col("valid"), F.lit(False))
    return found.groupBy("base_url").agg(
        count("subpage").alias("subpages"), count("image").alias("images"),
        count("subpage", ok).alias("valid_subpages"), count("image", ok).alias("valid_images"))


def host_statistics(log: DataFrame, keys: list[str] = ("host",), order: list[str] = ("ts", "seq"),
                    recent: int = 50) -> DataFrame:
    """Success rate, 502s and other server errors per host; mean response of the last successes."""
    s = F.col("status")
    good = s.between(200, 299)
    out = log.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if(good).alias("successes"), F.count_if(s == 502).alias("total_502"),
        F.count_if(s >= 500).alias("server_errors"))
    fast = last_rows(log.filter(good), list(keys), list(order), recent).groupBy(*keys).agg(
        F.avg("response_ms").alias("avg_response_ms"))
    return out.join(fast, list(keys), "left").withColumn("success_rate", F.col("successes") / F.col("requests")).withColumn(
        "avg_response_ms", F.coalesce("avg_response_ms", F.lit(0.0)))


def advised_workers(total, success, server_errors, workers, most: int = 20) -> Column:
    """Width of parallel work from the success and server error rates."""
    n = F.col(workers) if isinstance(workers, str) else F.lit(workers)
    err, ok = F.col(server_errors) / F.col(total), F.col(success) / F.col(total)
    return (F.when(F.col(total) == 0, n).when(err > 0.2, F.greatest(F.lit(1), F.floor(n / 2).cast("int")))
            .when(ok < 0.3, F.greatest(F.lit(1), n - 2)).when(ok < 0.6, n)
            .otherwise(F.least(n + 1, F.lit(most))))


def host_advice(total_502, success_rate, avg_response_seconds, healthy) -> Column:
    """Advice texts for a host, in order."""
    return F.array_compact(F.array(
        F.when(F.col(total_502) > 10, HOST_ADVICE["errors"]), F.when(F.col(success_rate) < 0.8, HOST_ADVICE["success"]),
        F.when(avg_response_seconds > 10, HOST_ADVICE["slow"]), F.when(~healthy, HOST_ADVICE["unhealthy"])))


def task_width(task_type, cpu, memory, cores: int) -> Column:
    """Workers for download, parse and other tasks from processor and memory load."""
    t, c, m = F.col(task_type), F.col(cpu), F.col(memory)
    def pick(calm, mid, a, b, rest):
        return F.when((c < calm[0]) & (m < calm[1]), a).when((c < mid[0]) & (m < mid[1]), b).otherwise(rest)
    return (F.when(t == "download", pick((50, 70), (70, 80), min(20, cores * 4), min(10, cores * 2), max(2, cores)))
            .when(t == "parse", pick((60, 70), (80, 85), cores, max(1, cores // 2), 1))
            .when(t == "process", pick((50, 60), (70, 80), min(8, cores * 2), cores, max(1, cores // 2)))
            .otherwise(4))


def hit_rate(log: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, misses and the hit rate in percent; ``log(hit)``."""
    out = log.groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return out.withColumn("hit_rate", F.col("hits") * 100.0 / F.greatest(F.lit(1), F.col("hits") + F.col("misses")))


# ---------------------------------------------------------------- progress

def with_speed(progress: DataFrame, order: list[str] = ("ts", "seq"), rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """Speed since the row before of the same url; 0 for the first row and without elapsed time."""
    rows = O.previous(progress, ["url"], list(order), {"_bytes": "downloaded", "_ts": "ts"}, rows_per_chunk)
    dt = P.seconds_between("_ts", "ts")
    speed = F.when(dt > 0, (F.col("downloaded") - F.col("_bytes")) / dt).otherwise(0.0)
    return rows.withColumn("speed", F.coalesce(speed, F.lit(0.0))).drop("_bytes", "_ts")


def task_progress(images: DataFrame, started: str | None = None, now=None, task: str = "task_id") -> DataFrame:
    """Per task the bytes, the sum of positive speeds and the remaining seconds; after ``overlay_progress``."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = images.groupBy(task).agg(
        F.count("*").alias("total_files"), F.count_if(F.col("status") == "completed").alias("completed_files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"), zero("downloaded").alias("downloaded_bytes"),
        zero("total").alias("total_bytes"),
        F.coalesce(F.sum(F.when(F.col("speed") > 0, F.col("speed"))), F.lit(0.0)).alias("current_speed"))
    left = F.col("total_bytes") - F.col("downloaded_bytes")
    eta = F.when((F.col("current_speed") > 0) & (left > 0), F.floor(left / F.col("current_speed"))).otherwise(0)
    return out.withColumn("eta_seconds", eta.cast("bigint"))


def status_transitions(progress: DataFrame, order: list[str] = ("ts", "seq"), rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """Rows at which the status of a url changed, with the old one."""
    rows = O.previous(progress, ["url"], list(order), {"old_status": "status"}, rows_per_chunk)
    return rows.filter(~F.col("old_status").eqNullSafe(F.col("status")))


def current_status(progress: DataFrame, order: list[str] = ("ts", "seq")) -> DataFrame:
    """The last status per url."""
    return keep_last(progress.select("url", "status", *order), ["url"], list(order)).select("url", "status")
