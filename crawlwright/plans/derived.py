"""Tables derived from the given ones, once in Spark and once as SQL text.

``pages`` has no images and ``part`` no urls, so the image, task, log and
gallery tables the operators need are projections of ``part``, ``orders``,
``lineitem`` and ``events``: they have as many rows as their source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import shared_folder
from .registry import Tables

# ------------------------------------------------------------------- images

_FOLDERS = ["/uploadfile/2024/5/", "/pic/", "/images/full/", "/thumb/", "/a/shadow/"]
_EXTS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".svg", ""]
_TYPES = ["image/jpeg", "image/png", "text/html", "image/tiff"]

_PICK = lambda items, index: "CASE " + " ".join(
    f"WHEN {index} = {i} THEN '{x}'" for i, x in enumerate(items)) + " END"

_FILENAME = (f"CASE WHEN p_partkey % 5 = 1 THEN concat(CAST(p_partkey AS STRING), {_PICK(_EXTS, 'p_partkey % 8')}) "
             f"ELSE concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING), {_PICK(_EXTS, 'p_partkey % 8')}) END")
_IMAGE_COLUMNS = f"""
    p_partkey AS image_id,
    concat('http://h', CAST(p_size % 7 AS STRING), '.example.com/g/', CAST(p_partkey % 50 AS STRING), '.html') AS page_url,
    concat('http://h', CAST(p_size % 7 AS STRING), '.example.com', {_PICK(_FOLDERS, 'p_partkey % 5')}, {_FILENAME}) AS url,
    {_FILENAME} AS filename,
    lower(p_type) AS alt_text, p_brand AS title,
    CASE WHEN p_size % 9 = 0 THEN 'avatar-box' ELSE 'box' END AS css_class,
    concat('e', CAST(p_size AS STRING)) AS element_id,
    CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 60 END AS width,
    CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size * 37 END AS height,
    CASE WHEN p_size % 13 = 0 THEN NULL ELSE CAST(p_size * p_size * p_size * 500 AS BIGINT) END AS file_size,
    {_PICK(_TYPES, 'p_size % 4')} AS content_type
"""
IMAGES_SQL = f"images AS (SELECT {_IMAGE_COLUMNS.replace('STRING', 'VARCHAR')} FROM part)"


def images(t: Tables) -> DataFrame:
    """Image candidates from ``part``."""
    return t.part.selectExpr(*_split(_IMAGE_COLUMNS))


def _split(columns: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, quoted, cur = [], 0, False, ""
    for ch in columns:
        quoted ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quoted else 0
        if ch == "," and depth == 0 and not quoted:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


# -------------------------------------------------------------------- files

_FILE_COLUMNS = """
    concat('d', CAST(p_partkey % 50 AS STRING)) AS dir,
    concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING),
           CASE p_size % 8 WHEN 0 THEN '.JPG' WHEN 1 THEN '.txt' WHEN 2 THEN '.png' WHEN 3 THEN '' WHEN 4 THEN '.env'
           WHEN 5 THEN '.bak' WHEN 6 THEN '.pem' ELSE '.webp' END) AS filename,
    CASE WHEN p_size = 13 THEN CAST(0 AS BIGINT) ELSE CAST(p_size * 37 AS BIGINT) END AS length
"""
FILES_SQL = f"files AS (SELECT {_FILE_COLUMNS.replace('STRING', 'VARCHAR')} FROM part)"


def files(t: Tables) -> DataFrame:
    """A file listing from ``part``."""
    return t.part.selectExpr(*_split(_FILE_COLUMNS))


# -------------------------------------------------------------------- tasks

_TASK_COLUMNS = """
    o_orderkey AS task_id, concat('task ', CAST(o_custkey % 100 AS STRING)) AS name,
    concat('http://t', CAST(o_custkey % 40 AS STRING), '.example.com/set/', CAST(o_orderkey AS STRING), '.html') AS base_url,
    CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
    o_orderdate AS created_time, o_orderdate AS scheduled_time, o_orderdate AS completed_time,
    CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
    CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 1000 AS INT) * 60 END AS repeat_minutes,
    CAST(o_orderkey % 90 + 10 AS BIGINT) AS total_images, CAST(o_orderkey % 60 AS BIGINT) AS downloaded_images,
    CAST(o_orderkey % 7 AS BIGINT) AS failed_images
"""
TASKS_SQL = f"tasks AS (SELECT {_TASK_COLUMNS.replace('STRING', 'VARCHAR')} FROM orders)"


def tasks(t: Tables) -> DataFrame:
    """Download tasks from ``orders``."""
    return t.orders.selectExpr(*_split(_TASK_COLUMNS))


_ATTEMPT_COLUMNS = """
    l_orderkey AS task_id, l_suppkey AS host, l_linenumber AS seq, l_shipdate AS ts,
    concat('http://i.example.com/', CAST(l_partkey AS STRING), '.jpg') AS url,
    CASE WHEN l_returnflag = 'A' THEN 'success' WHEN l_returnflag = 'R' THEN 'failed'
         WHEN l_linestatus = 'O' THEN 'skipped' ELSE 'success' END AS outcome,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 502 WHEN l_returnflag = 'R' THEN 404 ELSE 200 END AS status,
    CAST(l_linenumber - 1 AS BIGINT) AS retries, CAST(l_quantity AS BIGINT) * 1024 AS bytes,
    CAST(l_quantity AS DOUBLE) / 4 AS seconds
"""
ATTEMPTS_SQL = f"attempts AS (SELECT {_ATTEMPT_COLUMNS.replace('STRING', 'VARCHAR')} FROM lineitem)"


def attempts(t: Tables) -> DataFrame:
    """Download attempts from ``lineitem``."""
    return t.lineitem.selectExpr(*_split(_ATTEMPT_COLUMNS))


# ------------------------------------------------------------- time series

SAMPLES_SQL = "samples AS (SELECT event_type AS name, value, ts, event_id AS seq, user_id FROM events)"


def samples(t: Tables) -> DataFrame:
    """Metric samples from ``events``."""
    return t.events.select(F.col("event_type").alias("name"), "value", "ts", F.col("event_id").alias("seq"), "user_id")


_METRIC_TYPE = ("CASE event_type WHEN 'view' THEN 'counter' WHEN 'click' THEN 'gauge' WHEN 'error' THEN 'timer' "
                "WHEN 'signup' THEN 'rate' ELSE 'counter' END")
METRICS_SQL = f"""metrics AS (SELECT {_METRIC_TYPE} AS metric_type, concat(event_type, '_', CAST(user_id % 5 AS VARCHAR)) AS name,
    value, ts, event_id AS seq FROM events)"""


def metrics(t: Tables) -> DataFrame:
    """Typed metric samples from ``events``."""
    return t.events.selectExpr(f"{_METRIC_TYPE} AS metric_type", "concat(event_type, '_', CAST(user_id % 5 AS STRING)) AS name",
                               "value", "ts", "event_id AS seq")


_LOG_COLUMNS = """
    concat('u', CAST(user_id AS STRING)) AS host, ts, event_id AS seq,
    CASE event_type WHEN 'error' THEN 502 WHEN 'click' THEN 404 WHEN 'signup' THEN 500 ELSE 200 END AS status,
    value AS response_ms, CAST(round(value * 100) AS BIGINT) AS bytes
"""
LOG_SQL = f"log AS (SELECT {_LOG_COLUMNS.replace('STRING', 'VARCHAR')} FROM events)"


def request_log(t: Tables) -> DataFrame:
    """A request log from ``events``; the user is the host."""
    return t.events.selectExpr(*_split(_LOG_COLUMNS))


_REPORT_COLUMNS = """
    event_id AS seq, ts,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' WHEN 'signup' THEN 'critical' ELSE 'info' END AS level,
    concat('Error', CAST(user_id % 17 AS STRING)) AS exception_type, concat('failed in ', event_type) AS message,
    user_id, value
"""
REPORTS_SQL = f"reports AS (SELECT {_REPORT_COLUMNS.replace('STRING', 'VARCHAR')} FROM events)"


def reports(t: Tables) -> DataFrame:
    """Error reports from ``events``."""
    return t.events.selectExpr(*_split(_REPORT_COLUMNS))


_PROGRESS_COLUMNS = """
    concat('http://i.example.com/', CAST(user_id AS STRING), '.jpg') AS url, user_id % 20 AS task_id, ts, event_id AS seq,
    CAST(round(value * 1000) AS BIGINT) AS downloaded, CAST(500000 AS BIGINT) AS total,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'pending'
         ELSE 'downloading' END AS status
"""
PROGRESS_SQL = f"progress AS (SELECT {_PROGRESS_COLUMNS.replace('STRING', 'VARCHAR')} FROM events)"


def progress(t: Tables) -> DataFrame:
    """A download progress log from ``events``."""
    return t.events.selectExpr(*_split(_PROGRESS_COLUMNS))


# ------------------------------------------------------------- written sources

def written(df: DataFrame, kind: str) -> str:
    """A fresh path below the shared folder with ``df`` in the given format, for readers to read."""
    path = f"{shared_folder(df.sparkSession)}/source-{uuid.uuid4().hex}"
    df.write.format(kind).save(path)
    return path


# ---------------------------------------------------------------- galleries

_GALLERY = """concat(
 '<html><head><title>', p_name, ' ', CAST(p_partkey AS STRING), '</title>',
 '<style>.x{background:url("/css/', CAST(p_size AS STRING), '.png")}</style><style>p{color:red}</style></head><body>',
 '<nav><a href="/cat/', CAST(p_size AS STRING), '.html">Cat</a></nav>',
 CASE WHEN p_partkey % 3 = 0 THEN '<section class="container main">' ELSE '<div class="container">' END,
 '<a href="/Xiuren/Xiuren', CAST(p_partkey AS STRING), '.html">one</a>',
 '<a href="/Xiuren/Xiuren', CAST(p_partkey + 1 AS STRING), '.html">two</a>',
 '<a href="http://ads.example.com/x.html">ad</a>',
 CASE WHEN p_partkey % 3 = 0 THEN '</section>' ELSE '</div>' END,
 '<img src="/full/', CAST(p_partkey AS STRING), '.jpg" width="', CAST(p_size * 60 AS STRING), '" height="900" alt="', p_type, '">',
 '<img src="/full/', CAST(p_partkey AS STRING), '.jpg">',
 '<img src="data:image/png;base64,AAAA" data-src="/lazy/', CAST(p_partkey AS STRING), '.webp">',
 '<img src="" data-original="/orig/', CAST(p_partkey AS STRING), '.png" width="auto">',
 '<img src="/img/logo', CAST(p_partkey AS STRING), '.png">',
 '<div style="background-image: url(/bg/', CAST(p_partkey AS STRING), '.gif)"></div>',
 '<a href="/big/', CAST(p_partkey AS STRING), '.jpeg">Large</a>',
 '<div class="related box"><a href="/rel/', CAST(p_partkey % 10 AS STRING), '.html">More like it</a></div>',
 CASE WHEN p_partkey % 4 = 0 THEN concat('<div class="pagination"><a class="current" href="/g/', CAST(p_partkey AS STRING),
      '.html">1</a><a href="/g/', CAST(p_partkey AS STRING), '_2.html">2</a><a href="/g/', CAST(p_partkey AS STRING),
      '_3.html">3</a><a href="/g/', CAST(p_partkey AS STRING), '_2.html">next</a></div>') ELSE '' END,
 '<!-- <img src="/hidden/', CAST(p_partkey AS STRING), '.jpg"> --></body></html>')"""
_GALLERY_URL = "concat('http://g', CAST(p_size AS STRING), '.example.com/g/', CAST(p_partkey AS STRING), '.html')"


def galleries(t: Tables) -> DataFrame:
    """Gallery pages with images, styles, containers and paging, one per part."""
    return t.spread(t.part, "p_partkey").select(F.col("p_partkey").alias("page_id"), F.expr(_GALLERY_URL).alias("url"),
                         F.expr(_GALLERY).alias("html"))


# one SQL text for both sides: a page of links of every kind that sub-page rules tell apart
_ALBUM = """SELECT p_partkey AS page_id, concat('http://a', CAST(p_size AS STRING), '.example.com/xiuren/', CAST(p_partkey AS STRING), '.html') AS url,
  concat('<html><body><!-- <a href="/xiuren/9.html">hidden</a> --><a href="/xiuren/', CAST(p_partkey AS STRING), '_', CAST(p_size AS STRING),
    '.html">next</a><a href="/xiuren/about.html">about</a><a href="/Photos/', CAST(p_partkey AS STRING), '/">all</a><a href="/xgyw/set',
    CAST(p_size AS STRING), '.html">set</a><a href="#top">top</a><a href="/list/page-', CAST(p_size AS STRING), '">list</a><a href="/', CAST(p_partkey AS STRING),
    '/?x=1">one</a><a href="/xiuren/', CAST(p_partkey AS STRING), '_', CAST(p_size AS STRING), '.html">again</a></body></html>') AS html FROM """
ALBUM_SQL = f"pages AS ({_ALBUM.replace('STRING', 'VARCHAR')} part)"


def albums(t: Tables) -> DataFrame:
    """Pages of links, one per part."""
    return t.spark.sql(_ALBUM + "{part}", part=t.spread(t.part, "p_partkey"))


# the oracle never parses this markup: it states what is in it
GALLERY_SQL = f"""g AS (SELECT p_partkey AS page_id, {_GALLERY_URL.replace('STRING', 'VARCHAR')} AS page_url,
    concat('http://g', CAST(p_size AS VARCHAR), '.example.com') AS site, CAST(p_partkey AS VARCHAR) AS k,
    CAST(p_partkey + 1 AS VARCHAR) AS k1, p_partkey, p_size, p_type, p_name FROM part)"""
