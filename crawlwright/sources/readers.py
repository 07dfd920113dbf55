"""Sources: pages, file listings, logs, source trees, event logs, reports, samples, progress.

Every reader has a fixed schema, so nothing is inferred by an extra pass, and
takes a batch or (``stream=True``) a streaming read where that makes sense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered as O

PAGES = "page_id bigint, url string, html string"
SAMPLES = ("name string, metric_type string, value double, ts timestamp, tags map<string,string>, unit string, "
           "category string, seq bigint")
PROGRESS = "url string, ts timestamp, seq bigint, downloaded bigint, total bigint, status string"
EVENT = ("event_id string, timestamp string, metric_name string, current_value double, threshold_value double, "
         "severity string, message string, action_taken string")
REPORTS = ("report_id string, ts timestamp, level string, exception_type string, message string, "
           "context map<string,string>, user_id string, session_id string, seq bigint")


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Fetched pages; a page without markup stays, with an error text."""
    rows = _reader(spark, stream).schema(PAGES).parquet(path)
    return rows.withColumn("error_message", F.when(F.col("html").isNull(), "no content"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages kept as one file each; the file path stands for the url until one is joined on."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    file = F.col("_metadata.file_path")
    return rows.select(F.xxhash64(file).alias("page_id"), file.alias("url"), F.col("value").alias("html"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder with directory, name, size, time and suffix; no content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "modificationTime", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return rows.select(
        "path", F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), name.alias("filename"), "length",
        F.col("modificationTime").alias("modified"),
        F.lower(F.regexp_extract(name, r"(?<=[^.])(\.[^.]+)$", 1)).alias("suffix"))


def log_lines(spark: SparkSession, path: str, rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """S3: lines of log files with their number.

    Files are read in splits, so one huge log does not have to fit a task; the
    number comes from the split's offset and the order inside it.
    """
    rows = spark.read.text(path, pathGlobFilter="*.log", recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    return O.numbered(rows, ["file"], ["_start", "_at"], "line_no", rows_per_chunk).drop("_start", "_at")


def source_tree(spark: SparkSession, path: str, glob: str = "*.py", recursive: bool = True) -> DataFrame:
    """Whole texts of the source files below a folder."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents ``{events: [...]}``, one row per event."""
    rows = spark.read.schema(f"events array<struct<{_struct(EVENT)}>>").json(path, multiLine=True)
    return rows.select(F.explode("events").alias("e")).select("e.*").withColumn(
        "ts", F.to_timestamp("timestamp")).drop("timestamp")


def _struct(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (p.split() for p in schema.split(", ")))


def reports(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Error reports, one JSON object per line."""
    return _reader(spark, stream).schema(REPORTS).json(path)


def samples(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Metric samples as a long table."""
    return _reader(spark, stream).schema(SAMPLES).parquet(path)


def progress(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The append-only download progress log."""
    return _reader(spark, stream).schema(PROGRESS).parquet(path)


def with_collected(samples_df: DataFrame, *extra: tuple[str, DataFrame]) -> DataFrame:
    """V3: samples of custom collectors; their metric names start with the collector's name."""
    out = samples_df
    for collector, df in extra:
        out = out.unionByName(df.withColumn("name", F.concat_ws("_", F.lit(collector), "name")),
                              allowMissingColumns=True)
    return out
