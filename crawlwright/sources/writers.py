"""Sinks: JSON, CSV, wide CSV, text reports, side files and bounded logs.

Each sink is a frame that can be looked at plus a write; nothing goes through
the driver but the metric names a wide CSV needs for its header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from ..operators import ordered as O
from ..operators.stats import newest_rows

# Report texts.
NO_RATE = "N/A"
DESCRIPTION_FILE = "套图描述.txt"
DESCRIPTION_RULE = "—————— 套图描述 ——————"
MAX_DESCRIPTION_NAME = 200
VALID, INVALID = "有效", "无效"
REPORT = {
    "title": "=== 页面爬取报告 ===", "url": "目标URL: %s", "time": "爬取时间: %s",
    "subpage": ("=== 子页面 ===", "发现子页面: %s 个", "有效子页面: %s 个", "子页面列表:"),
    "image": ("=== 图片资源 ===", "发现图片: %s 个", "有效图片: %s 个", "图片列表:"),
    "errors": "=== 错误 ===", "statistics": "=== 统计 ===",
    "subpage_rate": "子页面有效率: ", "image_rate": "图片有效率: ",
}
KEPT_EVENTS = 1000


def flat(df: DataFrame) -> DataFrame:
    """K3: text columns for CSV; nested values as JSON, null as ''."""
    cols = []
    for f in df.schema:
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        text = F.to_json(f.name) if nested else F.col(f.name).cast("string")
        cols.append(F.coalesce(text, F.lit("")).alias(f.name))
    return df.select(*cols)


def export(df: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """K1 and K3: one export for every report; an unknown format is an error."""
    kind = format.lower()
    if kind == "json":
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        flat(df).write.mode(mode).csv(path, header=True)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported export format: {format}")


def wide_metrics(samples: DataFrame, names: list[str] | None = None) -> DataFrame:
    """K2: a row per instant, a column per metric of the first instant, '' where a value is missing."""
    if names is None:
        first = samples.agg(F.min("ts").alias("_first"))
        rows = samples.join(F.broadcast(first), F.col("ts") == F.col("_first")).groupBy("name").agg(
            F.min("seq").alias("seq")).orderBy("seq").collect()
        names = [r["name"] for r in rows]
    wide = samples.groupBy("ts").pivot("name", names).agg(F.min_by("value", "seq"))
    return wide.select("ts", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(n) for n in names])


def crawl_report(found: DataFrame, errors: DataFrame | None = None, when: str | None = None,
                 rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """K4: the crawl report of every base url as numbered lines ``(base_url, part, n, line)``.

    ``found(base_url, kind, url, valid)`` with kind subpage or image. Lines
    stay rows, so a base url with very many links needs no single row.
    """
    ok = F.coalesce(F.col("valid"), F.lit(False))
    stats = found.groupBy("base_url").agg(*[
        c for k in ("subpage", "image") for c in (
            F.count_if(F.col("kind") == k).alias(f"{k}_n"), F.count_if((F.col("kind") == k) & ok).alias(f"{k}_ok"))])
    line = lambda text, *args: F.format_string(text, *args) if args else F.lit(text)
    count = lambda c: F.col(c).cast("string")

    def rate(kind):
        return F.concat(F.lit(REPORT[f"{kind}_rate"]), F.when(F.col(f"{kind}_n") > 0, F.format_string(
            "%.1f%%", F.bround(F.col(f"{kind}_ok") * 100.0 / F.col(f"{kind}_n"), 1))).otherwise(NO_RATE))
    head = [line(REPORT["title"]), line(REPORT["url"], F.col("base_url"))]
    if when is not None:
        head.append(line(REPORT["time"], F.lit(when)))
    parts = {0: head, 6: [line(""), line(REPORT["statistics"]), rate("subpage"), rate("image")]}
    for part, kind in ((1, "subpage"), (3, "image")):
        title, n_text, ok_text, list_text = REPORT[kind]
        some = F.col(f"{kind}_n") > 0
        parts[part] = [line(""), line(title), line(n_text, count(f"{kind}_n")), line(ok_text, count(f"{kind}_ok")),
                       F.when(some, ""), F.when(some, list_text)]
    fixed = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(i).cast("bigint").alias("n"), text.alias("line"))
                      for p, texts in parts.items() for i, text in enumerate(texts)])
    rows = stats.select("base_url", F.explode(F.filter(fixed, lambda x: x["line"].isNotNull())).alias("x")).select(
        "base_url", "x.*")
    listed = O.numbered(found, ["base_url", "kind"], ["url"], "n", rows_per_chunk)
    rows = rows.unionByName(listed.select(
        "base_url", F.when(F.col("kind") == "subpage", 2).otherwise(4).alias("part"), "n",
        F.format_string("%s. %s [%s]", F.col("n").cast("string"), "url",
                        F.when(ok, VALID).otherwise(INVALID)).alias("line")))
    if errors is not None:
        numbered = O.numbered(errors, ["base_url"], ["seq"], "n", rows_per_chunk)
        title = errors.select("base_url").distinct().select(
            "base_url", F.explode(F.array(F.lit(""), F.lit(REPORT["errors"]))).alias("line")).select(
            "base_url", F.lit(5).alias("part"), F.when(F.col("line") == "", -1).otherwise(0).cast("bigint").alias("n"), "line")
        rows = rows.unionByName(title).unionByName(numbered.select(
            "base_url", F.lit(5).alias("part"), "n", F.concat(F.lit("- "), "error").alias("line")))
    return rows


def write_crawl_report(lines: DataFrame, path: str) -> None:
    """K4: one folder of text per base url, its lines in order."""
    ordered = lines.withColumn("page", F.md5("base_url")).repartitionByRange("page", "part", "n").sortWithinPartitions(
        "page", "part", "n")
    ordered.select("page", "line").write.partitionBy("page").text(path)


def page_descriptions(records: DataFrame, when: str) -> DataFrame:
    """K5: side file of every page with a description: ``(dir, filename, body)``."""
    title = U.strip(F.coalesce("title", F.lit("")))
    name = F.substr(U.sanitize_filename(title), F.lit(1), F.lit(MAX_DESCRIPTION_NAME))
    name = F.when(name.endswith(".txt"), name).otherwise(F.concat(name, F.lit(".txt")))
    text = U.strip("description")
    body = F.concat_ws("\n", F.concat(F.lit("页面标题: "), F.coalesce("title", F.lit(""))),
                       F.concat(F.lit("原始链接: "), "url"), F.lit(f"提取时间: {when}"), F.lit(""),
                       F.lit(DESCRIPTION_RULE), F.lit(""), text)
    return records.filter(text != "").select(
        U.task_directory("url").alias("dir"), F.when(title == "", DESCRIPTION_FILE).otherwise(name).alias("filename"),
        body.alias("body"))


def append_events(events: DataFrame, path: str) -> None:
    """K6: append to the event log; readers see it through :func:`kept_events`."""
    events.write.mode("append").parquet(path)


def kept_events(log: DataFrame, n: int = KEPT_EVENTS) -> DataFrame:
    """K6: the newest n events."""
    return newest_rows(log, ["ts", "event_id"], n)


def task_log(tasks: DataFrame, images: DataFrame) -> DataFrame:
    """K7: image rows with their task's record, for ``write.partitionBy('task_id').json``.

    The record is repeated per image and not built as one nested row, as a
    task may hold more images than fit a row.
    """
    info = F.struct(F.col("task_id").alias("id"), "name", "base_url", F.col("task_status").alias("status"),
                    "total_images", "downloaded_images", "failed_images")
    t = tasks.withColumnRenamed("status", "task_status").select("task_id", info.alias("task_info"))
    image = F.struct("filename", "url", "status", "progress", "size", "error_message")
    return t.join(images.select("task_id", image.alias("image")), "task_id", "left")


def write_task_log(log: DataFrame, path: str) -> None:
    log.write.option("ignoreNullFields", "false").partitionBy("task_id").json(path)
