"""Streams over the given tables, run to their end and read back; the SQL is that of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import sinks, streams
from . import derived as D
from .metric_queries import ALERTS_SQL, DOWNLOAD_SPEED_SQL, ERROR_TREND_SQL, alert_rules, metric_limits
from .registry import Tables, query
from .task_queries import HOST_HEALTH_SQL, RATE_ADMISSION_SQL


class Streams(Tables):
    """The tables of one folder as streams of files; all that is there now is one micro-batch.

    The path is a pattern, as a table may be one file and a plain path of a stream must be a folder.
    """

    def __getattr__(self, name: str) -> DataFrame:
        schema = super().__getattr__(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")


def _streams(t: Tables) -> Streams:
    return Streams(t.spark, t.folder)


@query("R1", ALERTS_SQL)
def alert_stream(t: Tables):
    """Alerts with a cooldown of one hour and the action of the first rule that holds."""
    found = streams.alert_stream(D.samples(_streams(t)), metric_limits(t), alert_rules(t), cooldown_seconds=3600)
    return sinks.drained(found.select("name", "seq", "severity", "action_taken")).drop(sinks.EPOCH)


@query("R4", RATE_ADMISSION_SQL)
def rate_limit_stream(t: Tables):
    """Token bucket per event type: one token every 20 minutes, four at most."""
    r = _streams(t).events.select("event_type", "ts", F.col("event_id").alias("seq"), F.lit(1).alias("need"))
    return sinks.drained(streams.rate_limit_stream(r, ["event_type"], 1 / 1200, 4.0)).drop(sinks.EPOCH)


@query("R5", HOST_HEALTH_SQL)
def host_health_stream(t: Tables):
    """The 502 run of every host."""
    found = streams.host_health_stream(D.request_log(_streams(t)))
    return sinks.drained(found.select("host", "seq", "run_502", "unhealthy")).drop(sinks.EPOCH)


@query("R6", DOWNLOAD_SPEED_SQL)
def download_speed_stream(t: Tables):
    found = streams.progress_stream(D.progress(_streams(t)))
    return sinks.drained(found.select("url", "seq", F.round("speed", 6).alias("speed"))).drop(sinks.EPOCH)


@query("R6 A5", f"""
WITH {D.PROGRESS_SQL}, l AS (SELECT task_id, url, arg_max(status, (ts, seq)) AS status FROM progress GROUP BY ALL)
SELECT task_id, status, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY ALL""")
def live_image_counts(t: Tables):
    """Images per task and current status, from the moves of every image."""
    moves = sinks.drained(streams.status_changes_stream(D.progress(_streams(t))))
    return streams.status_counts(moves)


@query("R7", ERROR_TREND_SQL)
def error_stream(t: Tables):
    """Reports per hour and level: counts that each micro-batch updates, the last of which stand."""
    counts = streams.error_stream(D.reports(_streams(t)))
    last = sinks.newest(sinks.drained(counts, "update"), ["start", "level", "exception_type"])
    return last.groupBy(F.unix_micros("start").alias("start"), "level").agg(F.sum("n").cast("bigint").alias("n"))


@query("R8", """
SELECT event_type, count(*) AS events, CAST(count(*) FILTER (value > 100) AS BIGINT) AS large FROM events GROUP BY event_type""")
def callback_counts(t: Tables):
    """Counts that one callback writes per micro-batch, while another one fails."""
    def write(path: str):
        def counted(batch: DataFrame, epoch: int) -> None:
            sinks.epoch_writer(path)(batch.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("value") > 100).alias("large")), epoch)

        def broken(batch: DataFrame, epoch: int) -> None:
            raise ValueError("this callback always fails")
        return streams.callbacks(broken, counted, log=lambda message: None)
    events = _streams(t).events.select("event_type", "value", F.lit(0).cast("bigint").alias("events"), F.lit(0).cast("bigint").alias("large"))
    return sinks.drained(events, write=write).groupBy("event_type").agg(F.sum("events").alias("events"), F.sum("large").alias("large"))
