"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``: one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import time

from pyspark.sql import SparkSession

from crawlwright.plans import all_queries

HEADLINE = [
    "link_inventory", "curated_domains", "page_info", "crawl_report", "subpages", "content_images", "all_images",
    "image_filter_reasons", "image_dedupe", "existing_antijoin", "directory_statistics", "text_risk", "secret_scan",
    "metric_statistics", "running_totals", "alert_runs", "alert_events", "hourly_limit", "rate_admission",
    "download_statistics", "image_status_counts", "task_log", "host_statistics", "error_trend", "host_health", "user_admission",
    "scan_summary", "fuzzy_tasks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": pathlib.Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
