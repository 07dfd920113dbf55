"""Queries over tasks, downloads, hosts and validated texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crypto as C
from ..functions import progress as P
from ..functions import urls as U
from ..functions import validation as V
from ..operators import alerts, joins, planning, scan, stats
from ..operators.columns import computed
from ..sources import writers
from . import derived as D
from . import sqltext as S
from .registry import Tables, query

# ---------------------------------------------------------------------- tasks


@query("A4", f"""
WITH {D.TASKS_SQL}
SELECT status, count(*) AS tasks, CAST(sum(total_images) AS BIGINT) AS total_images, CAST(sum(downloaded_images) AS BIGINT) AS downloaded_images,
  CAST(sum(failed_images) AS BIGINT) AS failed_images FROM tasks GROUP BY status""")
def task_statistics(t: Tables):
    return stats.task_statistics(D.tasks(t))


@query("U41 U35", f"""
WITH {D.TASKS_SQL}
SELECT task_id, round(downloaded_images * 100.0 / total_images, 6) AS percent, status IN ('completed', 'failed', 'cancelled') AS finished,
  round(downloaded_images / 7.0, 6) AS speed,
  CASE WHEN downloaded_images > 0 THEN round((total_images - downloaded_images) / (downloaded_images / 7.0), 6) END AS eta,
  CAST(3600 AS DOUBLE) AS duration FROM tasks""")
def task_progress_figures(t: Tables):
    x = D.tasks(t).withColumn("speed", P.speed("downloaded_images", F.lit(7.0)))
    return x.select("task_id", F.round(P.percent("downloaded_images", "total_images"), 6).alias("percent"),
                    P.is_finished("status").alias("finished"), F.round("speed", 6).alias("speed"),
                    F.round(P.eta("downloaded_images", "total_images", "speed"), 6).alias("eta"),
                    P.duration("created_time", F.lit(None).cast("timestamp"), F.col("created_time") + F.expr("interval 1 hour")).alias("duration"))


@query("T6", f"""
WITH {D.TASKS_SQL}
SELECT task_id, epoch_us(scheduled_time) AS scheduled, CAST(priority AS BIGINT) AS priority FROM tasks WHERE scheduled_time <= TIMESTAMP '1998-01-01 00:00:00'""")
def due_tasks(t: Tables):
    return planning.due_tasks(D.tasks(t), "1998-01-01 00:00:00").select(
        "task_id", F.unix_micros("scheduled_time").alias("scheduled"), F.col("priority").cast("bigint").alias("priority"))


@query("T6", f"""
WITH {D.TASKS_SQL}
SELECT task_id, concat(name, ' (重复)') AS name, epoch_us(completed_time) + repeat_minutes * 60000000::BIGINT AS next_time FROM tasks
WHERE status = 'completed' AND repeat_minutes > 0 AND epoch_us(completed_time) + repeat_minutes * 60000000::BIGINT <= epoch_us(TIMESTAMP '1998-01-01 00:00:00')""")
def due_repeats(t: Tables):
    return planning.due_repeats(D.tasks(t), "1998-01-01 00:00:00").select("task_id", "name", F.unix_micros("next_time").alias("next_time"))


@query("F41", f"WITH {D.TASKS_SQL} SELECT task_id, status FROM tasks WHERE task_id = 7")
def task_lookup(t: Tables):
    return stats.by_id(D.tasks(t), "task_id", 7).select("task_id", "status")


_URLS_SQL = """urls AS (
  SELECT p_partkey AS id, concat('http://t', CAST(p_size % 5 AS VARCHAR), '.example.com/gallery/', replace(p_name, ' ', '-'), '-collection-', CAST(p_partkey AS VARCHAR), '.html') AS url FROM part
  UNION ALL SELECT -1 - p_partkey, concat('http://t', CAST(p_size % 5 AS VARCHAR), '.example.com/', p_name[1], CAST(p_partkey * 37 AS VARCHAR)) FROM part
  UNION ALL SELECT 1000000 + p_partkey, concat('/relative/', p_name) FROM part WHERE p_size = 50),
known AS (
  SELECT concat('http://t', CAST(c_nationkey % 5 AS VARCHAR), '.example.com/gallery/', CASE WHEN c_custkey % 2 = 0 THEN 'small-ring' ELSE 'red-widget' END, '-collection-', CAST(c_custkey * 11 AS VARCHAR), '.html') AS base_url FROM customer
  UNION ALL SELECT concat('http://t', CAST(c_nationkey % 5 AS VARCHAR), '.example.com/s', CAST(c_custkey * 1000 AS VARCHAR)) FROM customer
  UNION ALL SELECT concat('http://t', CAST(c_nationkey % 5 AS VARCHAR), '.example.com/gallery/blue-bolts-colection-', CAST(c_custkey * 7 AS VARCHAR), '.htm') FROM customer)"""
_P = S.path("url")
_SIMILAR_SQL = rf"""up AS (SELECT id, url, {S.netloc('url')} AS host, regexp_replace({_P}, '^/+|/+$', '', 'g') AS p FROM urls),
kp AS (SELECT DISTINCT base_url, {S.netloc('base_url')} AS host, regexp_replace({S.path('base_url')}, '^/+|/+$', '', 'g') AS p FROM known),
flagged AS (SELECT up.id, bool_or(coalesce(up.url = kp.base_url OR (up.p <> '' AND kp.p <> '' AND
    (greatest(length(up.p), length(kp.p)) - levenshtein(up.p, kp.p)) / greatest(length(up.p), length(kp.p)) > 0.9::DOUBLE), false)) AS task_exists
  FROM up LEFT JOIN kp USING (host) GROUP BY up.id)"""


def _task_urls(t: Tables):
    n = lambda c: F.col(c).cast("string")
    host = F.concat(F.lit("http://t"), (F.col("p_size") % 5).cast("string"), F.lit(".example.com/"))
    long = F.concat(host, F.lit("gallery/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-collection-"), n("p_partkey"), F.lit(".html"))
    short = F.concat(host, F.substr("p_name", F.lit(1), F.lit(1)), (F.col("p_partkey") * 37).cast("string"))
    part = t.spread(t.part, "p_partkey")
    return (part.select(F.col("p_partkey").alias("id"), long.alias("url"))
            .unionByName(part.select((-F.col("p_partkey") - 1).alias("id"), short.alias("url")))
            .unionByName(part.filter("p_size = 50").select((F.col("p_partkey") + 1000000).alias("id"), F.concat(F.lit("/relative/"), "p_name").alias("url"))))


def _known_tasks(t: Tables):
    host = F.concat(F.lit("http://t"), (F.col("c_nationkey") % 5).cast("string"), F.lit(".example.com/"))
    n = lambda k: (F.col("c_custkey") * k).cast("string")
    name = F.when(F.col("c_custkey") % 2 == 0, "small-ring").otherwise("red-widget")
    return t.spread(t.customer, "c_custkey").select(F.explode(F.array(
        F.concat(host, F.lit("gallery/"), name, F.lit("-collection-"), n(11), F.lit(".html")),
        F.concat(host, F.lit("s"), n(1000)),
        F.concat(host, F.lit("gallery/blue-bolts-colection-"), n(7), F.lit(".htm")))).alias("base_url"))


@query("J2 U23 U24", f"""
WITH {_URLS_SQL}, {_SIMILAR_SQL} SELECT id, task_exists FROM flagged""")
def fuzzy_tasks(t: Tables):
    return joins.with_task_flag(_task_urls(t), _known_tasks(t)).select("id", "task_exists")


_VALIDATED_SQL = f"""dirs AS (SELECT concat('small-ring-collection-', CAST(p_partkey AS VARCHAR)) AS d FROM part WHERE p_size < 25),
st AS (SELECT url, CASE WHEN id % 4 = 0 THEN 500 ELSE 200 END AS status, id % 3 <> 0 AS img FROM urls WHERE id >= 0),
v0 AS (SELECT up.url, any_value(f.task_exists) AS te, CASE WHEN up.p = '' THEN 'x' ELSE {S.stem(S.base('up.p'))} END AS dn
  FROM up JOIN flagged f USING (id) GROUP BY up.url, up.p),
v1 AS (SELECT v0.url, replace(dn, ' ', ' ') AS directory_name, {S.scheme('v0.url')} <> '' AND {S.netloc('v0.url')} <> '' AS ok, te,
   EXISTS (SELECT 1 FROM dirs WHERE d = dn) AS de, coalesce(st.status < 400, false) AS up_, coalesce(st.img, false) AS im
  FROM v0 LEFT JOIN st ON st.url = v0.url),
validated AS (SELECT url, directory_name, ok AND NOT (de OR te) AND up_ AS is_valid,
  CASE WHEN NOT ok THEN '无效的URL格式' WHEN de OR te THEN '跳过已存在的任务' WHEN NOT up_ THEN '页面无法访问且可能不包含图片' WHEN NOT im THEN '页面可能不包含图片内容' ELSE '' END AS reason,
  NOT ok OR up_ AS network_accessible, ok AND de AS directory_exists, ok AND te AS task_exists, ok AND up_ AND im AS has_images FROM v1)"""


def _validated(t: Tables):
    urls = _task_urls(t)
    dirs = t.part.filter("p_size < 25").select(F.concat(F.lit("small-ring-collection-"), F.col("p_partkey").cast("string")).alias("directory_name"))
    status = urls.filter("id >= 0").select("url", F.when(F.col("id") % 4 == 0, 500).otherwise(200).alias("status"),
                                           (F.col("id") % 3 != 0).alias("has_images"))
    return planning.validate_tasks(urls, _known_tasks(t), dirs, status)


@query("F39 J2 J3 U20", f"""
WITH {_URLS_SQL}, {_SIMILAR_SQL}, {_VALIDATED_SQL} SELECT * FROM validated""")
def validated_tasks(t: Tables):
    return _validated(t)


@query("U44", f"""
WITH {_URLS_SQL}, {_SIMILAR_SQL}, {_VALIDATED_SQL}
SELECT url, CAST(CASE WHEN has_images THEN 50 ELSE 0 END AS BIGINT) AS estimated_images, CASE WHEN has_images THEN '约50MB' ELSE '未知' END AS estimated_size,
  directory_name, CASE WHEN is_valid THEN '新建' WHEN directory_exists THEN '目录已存在' WHEN task_exists THEN '任务已存在' ELSE '无效' END AS status,
  is_valid AS selected, CASE WHEN NOT is_valid THEN reason END AS error_message FROM validated""")
def task_previews(t: Tables):
    return planning.preview_tasks(_validated(t)).withColumn("estimated_images", F.col("estimated_images").cast("bigint"))


@query("U45", f"""
WITH {_URLS_SQL}, {_SIMILAR_SQL}, {_VALIDATED_SQL}
SELECT directory_name AS name, url AS base_url, 'downloads' AS download_path, CAST(1 AS BIGINT) AS max_depth FROM validated WHERE is_valid""")
def created_tasks(t: Tables):
    return planning.task_rows(_validated(t), "downloads").select(
        "name", "base_url", "download_path", F.col("max_depth").cast("bigint").alias("max_depth"))


@query("A2 A3", f"""
WITH {_URLS_SQL}, {_SIMILAR_SQL}, {_VALIDATED_SQL}
SELECT count(*) AS total, count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS invalid,
  count(*) FILTER (directory_exists OR task_exists) AS duplicate, count(*) FILTER (NOT network_accessible) AS network_issues,
  count(*) FILTER (NOT has_images) AS no_images, count(*) FILTER (NOT is_valid AND (directory_exists OR task_exists)) AS duplicate_skipped,
  count(*) FILTER (NOT is_valid AND NOT (directory_exists OR task_exists)) AS failed_analysis,
  round(count(*) FILTER (is_valid) / count(*), 6) AS validation_rate FROM validated""")
def validation_statistics(t: Tables):
    out = stats.validation_statistics(_validated(t))
    return out.withColumn("validation_rate", F.round("validation_rate", 6))


@query("A31", f"""
WITH {D.FILES_SQL}, {D.TASKS_SQL},
have AS (SELECT dir, count(*) AS n FROM files WHERE regexp_matches(lower(filename), '\\.(jpg|jpeg|png|webp|gif|bmp)$') GROUP BY dir)
SELECT task_id, CASE WHEN have.n > 0 THEN 'completed' ELSE 'failed' END AS status, coalesce(have.n, 0) AS image_files,
  CASE WHEN have.n > 0 THEN NULL ELSE '目录中没有图片文件' END AS error_message
FROM (SELECT task_id, concat('d', CAST(task_id % 70 AS VARCHAR)) AS dir FROM tasks) LEFT JOIN have USING (dir)""")
def task_outcomes(t: Tables):
    x = D.tasks(t).select("task_id", F.concat(F.lit("d"), (F.col("task_id") % 70).cast("string")).alias("dir"))
    return stats.task_outcomes(x, D.files(t)).select("task_id", "status", "image_files", "error_message")


@query("W12", None)
def unique_task_names(t: Tables):
    """Names of all tasks made unique against directories that exist; order dependent, so rows only."""
    taken = t.supplier.select(F.concat(F.lit("task "), F.col("s_suppkey").cast("string")).alias("name"))
    rows = D.tasks(t).select("task_id", "name")
    return planning.unique_names(rows, taken, ["task_id"])


# ------------------------------------------------------------------ downloads

_DL = """count(*) AS total, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'failed') AS failed,
  count(*) FILTER (outcome = 'skipped') AS skipped, CAST(sum(retries) AS BIGINT) AS retry, count(*) FILTER (status >= 500) AS server_errors,
  CAST(sum(bytes) AS BIGINT) AS bytes_downloaded, false AS in_progress, round(sum(bytes) / sum(seconds), 4) AS speed,
  round(count(*) FILTER (outcome = 'success') * 100.0 / count(*), 4) AS success_rate"""


@query("A6", f"WITH {D.ATTEMPTS_SQL} SELECT {_DL} FROM attempts")
def download_statistics(t: Tables):
    out = stats.download_statistics(D.attempts(t))
    return out.withColumn("speed", F.round("speed", 4)).withColumn("success_rate", F.round("success_rate", 4))


@query("A6 A28", f"""
WITH {D.ATTEMPTS_SQL}, d AS (SELECT host, {_DL} FROM attempts GROUP BY host)
SELECT *, CAST(CASE WHEN server_errors / total > 0.2 THEN 4 WHEN success / total < 0.3 THEN 6 WHEN success / total < 0.6 THEN 8 ELSE 9 END AS BIGINT) AS workers FROM d""")
def download_advice(t: Tables):
    out = stats.download_statistics(D.attempts(t), ["host"])
    return (out.withColumn("speed", F.round("speed", 4)).withColumn("success_rate", F.round("success_rate", 4))
            .withColumn("workers", stats.advised_workers("total", "success", "server_errors", 8).cast("bigint")))


@query("A5", f"""
WITH {D.ATTEMPTS_SQL}, x AS (SELECT task_id, CASE outcome WHEN 'success' THEN 'completed' WHEN 'skipped' THEN 'downloading' ELSE CASE WHEN status = 502 THEN 'failed' ELSE 'waiting' END END AS s FROM attempts)
SELECT task_id, count(*) AS total, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'downloading') AS downloading,
  count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'waiting') AS pending FROM x GROUP BY task_id""")
def image_status_counts(t: Tables):
    s = F.when(F.col("outcome") == "success", "completed").when(F.col("outcome") == "skipped", "downloading").when(
        F.col("status") == 502, "failed").otherwise("waiting")
    return stats.image_status_counts(D.attempts(t).select("task_id", s.alias("status")))


@query("A29", f"""
WITH {D.ATTEMPTS_SQL}
SELECT host, count(*) FILTER (outcome = 'success') AS hits, count(*) FILTER (outcome <> 'success') AS misses,
  round(count(*) FILTER (outcome = 'success') * 100.0 / count(*), 6) AS hit_rate FROM attempts GROUP BY host""")
def hit_rates(t: Tables):
    out = stats.hit_rate(D.attempts(t).select("host", (F.col("outcome") == "success").alias("hit")), ["host"])
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


@query("A20 T3 A21 W8", """
WITH f AS (SELECT concat(CASE WHEN l_suppkey % 3 = 0 THEN 'file_' ELSE 'request_' END, CAST(l_suppkey AS VARCHAR)) AS name, l_quantity / 100 AS v FROM lineitem),
s AS (SELECT name, count(*) AS calls, sum(v) AS total_time FROM f GROUP BY name),
top AS (SELECT *, sum(total_time) OVER () AS all_time FROM s ORDER BY total_time DESC, name LIMIT 10)
SELECT name, calls, round(total_time, 4) AS total_time, round(total_time / calls, 6) AS average_time, round(total_time / all_time * 100, 4) AS percentage,
  concat_ws('; ', CASE WHEN calls > 10000 THEN '考虑减少函数调用次数或使用缓存' END, CASE WHEN total_time / calls > 0.1 THEN '函数执行时间较长，考虑算法优化' END,
    CASE WHEN contains(name, 'file') THEN 'I/O操作较多，考虑批量处理或异步操作' END, CASE WHEN contains(name, 'request') THEN '网络操作较多，考虑连接池或并发处理' END) AS advice FROM top""")
def hot_spots(t: Tables):
    f = t.lineitem.select(F.concat(F.when(F.col("l_suppkey") % 3 == 0, "file_").otherwise("request_"), F.col("l_suppkey").cast("string")).alias("name"),
                          (F.col("l_quantity") / 100).alias("value"))
    s = f.groupBy("name").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 6).alias("total_time"))
    return stats.hot_spots(s).select("name", "calls", F.round("total_time", 4).alias("total_time"), F.round("average_time", 6).alias("average_time"),
                                     F.round("percentage", 4).alias("percentage"), "advice")


@query("A22", """
WITH c AS (SELECT c_mktsegment AS type, c_acctbal AS before, c_acctbal - c_custkey % 50 AS after, c_custkey % 4 <> 0 AS success FROM customer)
SELECT type, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
  round(coalesce(sum(before - after) FILTER (success), 0), 3) AS saved, round(count(*) FILTER (success) * 100.0 / count(*), 6) AS success_rate FROM c GROUP BY type""")
def effect_statistics(t: Tables):
    c = t.customer.select(F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("before"),
                          (F.col("c_acctbal") - F.col("c_custkey") % 50).alias("after"), (F.col("c_custkey") % 4 != 0).alias("success"))
    out = stats.effect_statistics(c)
    return out.withColumn("saved", F.round("saved", 3)).withColumn("success_rate", F.round("success_rate", 6))


@query("J9", """
SELECT l_orderkey AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_linenumber AS n, l_partkey AS part FROM lineitem""")
def flattened_images(t: Tables):
    """Tasks with images of their own and of two pages, one of which may be empty."""
    image = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"))

    def lines(low: int, high: int):
        return F.array_sort(F.collect_list(F.when(F.col("l_linenumber").between(low, high), image)))
    tasks = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(
        lines(1, 2).alias("images"), F.array(F.struct(lines(3, 4).alias("images")), F.struct(lines(5, 99).alias("images"))).alias("pages"))
    return joins.task_images(tasks).select("task_id", F.col("pos").cast("bigint").alias("pos"), "n", "part")


@query("K7", f"""
WITH {D.TASKS_SQL}, {D.ATTEMPTS_SQL}
SELECT tasks.task_id, tasks.name, tasks.status AS task_status, attempts.url, attempts.outcome AS image_status
FROM tasks LEFT JOIN attempts USING (task_id)""")
def task_log(t: Tables):
    a = D.attempts(t).select("task_id", F.lit("f").alias("filename"), "url", F.col("outcome").alias("status"), F.lit(0.0).alias("progress"),
                             F.col("bytes").alias("size"), F.lit(None).cast("string").alias("error_message"))
    out = writers.task_log(D.tasks(t), a)
    return out.select("task_id", "task_info.name", F.col("task_info.status").alias("task_status"), "image.url", F.col("image.status").alias("image_status"))


@query("U40 F40", f"""
WITH {D.ATTEMPTS_SQL}
SELECT task_id, seq, least(60.0::DOUBLE, pow(2.0::DOUBLE, seq)) AS backoff, least(60.0::DOUBLE, pow(2.0::DOUBLE, seq - 1)) AS policy,
  least(60.0::DOUBLE, pow(2.0::DOUBLE, seq)) * CASE WHEN status = 502 THEN 2 ELSE 1 END AS adaptive,
  CASE WHEN status >= 500 THEN least(pow(2.0::DOUBLE, seq) * 2, 120.0::DOUBLE) ELSE least(60.0::DOUBLE, pow(2.0::DOUBLE, seq)) END AS download,
  seq < 4 AS again FROM (SELECT task_id, CAST(seq AS BIGINT) AS seq, status FROM attempts WHERE outcome = 'failed')""")
def retry_schedule(t: Tables):
    x = D.attempts(t).filter("outcome = 'failed'").withColumn("seq", F.col("seq").cast("bigint"))
    return x.select(
        "task_id", "seq", P.retry_delay("seq", jitter=False).alias("backoff"), P.retry_delay("seq", "policy", jitter=False).alias("policy"),
        P.retry_delay("seq", "adaptive", unhealthy=F.col("status") == 502).alias("adaptive"),
        P.retry_delay("seq", "download", server_error=F.col("status") >= 500).alias("download"), P.should_retry("seq", F.lit(4)).alias("again"))


# ------------------------------------------------------------------ validation

_XSS = (r"<script[^>]*>.*?</script>|javascript:|vbscript:|onload\s*=|onerror\s*=|onclick\s*=|onmouseover\s*=|<iframe[^>]*>|<object[^>]*>|"
        r"<embed[^>]*>|<link[^>]*>|<meta[^>]*>")
_SQLI = (r"union\s+select|drop\s+table|delete\s+from|insert\s+into|update\s+.*\s+set|exec\s*\(|execute\s*\(|sp_executesql|xp_cmdshell|;\s*--|;\s*/\*|"
         r"''\s*or\s*''|''\s*and\s*''|1\s*=\s*1|1\s*=\s*0")
_SHELL = (r";\s*rm\s|;\s*del\s|;\s*cat\s|;\s*type\s|;\s*ls\s|;\s*dir\s|;\s*wget\s|;\s*curl\s|;\s*nc\s|;\s*netcat\s|\|\s*nc\s|\|\s*netcat\s|`.*`|"
          r"\$\(.*\)|&&\s*rm\s|\|\|\s*rm\s")


@query("F28 F29", f"""
WITH x AS (SELECT concat('c', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS id, text FROM conversations
  UNION ALL SELECT concat('p', CAST(page_id AS VARCHAR)), html FROM pages UNION ALL SELECT concat('d', CAST(doc_id AS VARCHAR)), text FROM documents)
SELECT id, regexp_matches(lower(text), '{_XSS}') AS xss, regexp_matches(lower(text), '{_SQLI}') AS sql_injection, regexp_matches(text, '{_SHELL}') AS shell,
  NOT (regexp_matches(lower(text), '{_XSS}') OR regexp_matches(lower(text), '{_SQLI}') OR regexp_matches(text, '{_SHELL}')) AS valid FROM x""")
def text_risk(t: Tables):
    n = lambda c: F.col(c).cast("string")
    x = (t.conversations.select(F.concat(F.lit("c"), n("conv_id"), F.lit("-"), n("turn")).alias("id"), "text")
         .unionByName(t.html_pages.select(F.concat(F.lit("p"), n("page_id")).alias("id"), F.col("html").alias("text")))
         .unionByName(t.texts.select(F.concat(F.lit("d"), n("doc_id")).alias("id"), "text")))
    # one evaluation of the rules per text; the flags are read from its errors
    x = computed(x.select("id", "text"), checked=V.validate("text", "user_input"))
    has = lambda key: F.array_contains("checked.errors", V.ERRORS[key])
    return x.select("id", has("xss").alias("xss"), has("sql").alias("sql_injection"), has("shell").alias("shell"),
                    F.col("checked.valid").alias("valid"))


@query("F24 F27 F29", f"""
WITH x AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('http://192.168.', CAST(p_size AS VARCHAR), '.7/a.jpg') WHEN 1 THEN concat('ftp://f', CAST(p_size AS VARCHAR), '.example.com/a.png')
  WHEN 2 THEN concat('http://localhost/', p_name) WHEN 3 THEN concat('https://8.8.', CAST(p_size AS VARCHAR), '.8/a.svg') WHEN 4 THEN concat('http://ok.example.com/', CAST(p_partkey AS VARCHAR), '.webp')
  ELSE concat('http://ok.example.com/../', CAST(p_partkey AS VARCHAR)) END AS url, p_partkey % 6 AS m FROM part)
SELECT p_partkey, m IN (3, 4) AS valid_url,
  CASE m WHEN 0 THEN '域名不是可访问的公共域名' WHEN 1 THEN 'URL必须以http://或https://开头 | URL包含可疑模式' WHEN 2 THEN '域名不是可访问的公共域名'
    WHEN 5 THEN 'URL包含可疑模式' ELSE '' END AS errors, m = 4 AS paranoid, m IN (3, 4) AS valid_image FROM x""")
def url_validation(t: Tables):
    n, k, m = F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    url = (F.when(m == 0, F.concat(F.lit("http://192.168."), n, F.lit(".7/a.jpg"))).when(m == 1, F.concat(F.lit("ftp://f"), n, F.lit(".example.com/a.png")))
           .when(m == 2, F.concat(F.lit("http://localhost/"), "p_name")).when(m == 3, F.concat(F.lit("https://8.8."), n, F.lit(".8/a.svg")))
           .when(m == 4, F.concat(F.lit("http://ok.example.com/"), k, F.lit(".webp"))).otherwise(F.concat(F.lit("http://ok.example.com/../"), k)))
    x = t.part.select("p_partkey", url.alias("url"))
    x = x.select("p_partkey", V.validate("url", "url").alias("u"), V.validate("url", "url", "paranoid").alias("p"), V.validate("url", "image_url").alias("i"))
    return x.select("p_partkey", "u.valid", F.array_join("u.errors", " | ").alias("errors"), F.col("p.valid").alias("paranoid"),
                    F.col("i.valid").alias("valid_image")).select(
        "p_partkey", F.col("valid").alias("valid_url"), "errors", "paranoid", "valid_image")


@query("F25 F26 F29", f"""
WITH x AS (SELECT p_partkey, p_partkey % 5 AS m FROM part)
SELECT p_partkey, m IN (0, 4) AS valid_path, CASE m WHEN 1 THEN '路径包含目录遍历攻击' WHEN 2 THEN '路径包含无效字符' WHEN 3 THEN '不允许访问系统路径 | 不允许访问可执行文件路径' ELSE '' END AS path_errors,
  m IN (0, 1) AS valid_name, CASE m WHEN 2 THEN '文件名包含无效字符 | 文件扩展名不安全' WHEN 3 THEN '文件扩展名不安全' WHEN 4 THEN '文件名是系统保留名称' ELSE '' END AS name_errors FROM x""")
def path_validation(t: Tables):
    k, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    path = (F.when(m == 0, F.concat(F.lit("downloads/"), k, F.lit(".jpg"))).when(m == 1, F.concat(F.lit("../up/"), k)).when(m == 2, F.concat(F.lit("downloads/a:"), k))
            .when(m == 3, F.concat(F.lit("/etc/"), k, F.lit(".sh"))).otherwise(F.concat(F.lit("C:\\d\\"), k, F.lit(".png"))))
    name = (F.when(m == 0, F.concat(k, F.lit(".jpg"))).when(m == 1, F.concat(k, F.lit(".tar.gz"))).when(m == 2, F.concat(k, F.lit("?.doc")))
            .when(m == 3, F.concat(k, F.lit(".exe"))).otherwise(F.lit("con.txt")))
    x = t.part.select("p_partkey", V.validate(path, "file_path").alias("p"), V.validate(name, "filename").alias("n"))
    return x.select("p_partkey", F.col("p.valid").alias("valid_path"), F.array_join("p.errors", " | ").alias("path_errors"),
                    F.col("n.valid").alias("valid_name"), F.array_join("n.errors", " | ").alias("name_errors"))


# ----------------------------------------------------------------------- scan

def _scan_sql() -> str:
    rows, at = [], 0
    for category, patterns in scan.PATTERNS.items():
        for pattern, finding, level in patterns:
            rows.append(f"({at}, '{category}', '{scan.category_title(category)}', '{pattern.replace(chr(39), chr(39) * 2)}', '{level}')")
            at += 1
    return f"""patterns(pattern_no, category, title, pattern, level) AS (VALUES {', '.join(rows)}),
hits AS (SELECT doc_id, pattern_no, category, title, pattern, level, text, unnest(regexp_extract_all(text, concat('(?im)', pattern))) AS m,
   generate_subscripts(regexp_extract_all(text, concat('(?im)', pattern)), 1) AS k FROM documents, patterns WHERE regexp_matches(text, concat('(?im)', pattern)))"""


@query("J7", f"""
WITH {_scan_sql()},
walk AS (SELECT *, string_split_regex(text, concat('(?im)', pattern)) AS parts FROM hits),
lines AS (SELECT *, 1 + length(regexp_replace(array_to_string(parts[1:k], ''), '[^\\n]', '', 'g')) AS line_number FROM walk)
SELECT doc_id, category, level, CAST(line_number AS BIGINT) AS line_number, trim(string_split(text, chr(10))[line_number]) AS code_snippet,
  concat(category, '_', left(md5(concat(CAST(doc_id AS VARCHAR), '_', CAST(line_number AS VARCHAR), '_', pattern)), 8)) AS issue_id FROM lines""")
def secret_scan(t: Tables):
    rows = scan.scan_texts(t.texts.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "category", "level", F.col("line_number").cast("bigint").alias("line_number"), "code_snippet", "issue_id")


@query("A23", f"""
WITH {_scan_sql()}
SELECT 'category' AS kind, title AS value, count(*) AS n FROM hits GROUP BY title
UNION ALL SELECT 'level', l, count(h.level) FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) AS v(l) LEFT JOIN hits h ON h.level = l GROUP BY l""")
def scan_summary(t: Tables):
    return stats.issue_summary(scan.scan_texts(t.texts.select("doc_id", "text"), "doc_id"))


@query("U36", """SELECT doc_id, sha256(concat(text, 'pepper')) AS sha256, sha256(concat(text, 'pepper')) = sha256(concat(text, 'pepper')) AS verified FROM documents""")
def salted_hashes(t: Tables):
    h = C.hash_text("text", "sha256", "pepper")
    return t.documents.select("doc_id", h.alias("sha256"), C.verify_hash("text", h, "pepper").alias("verified"))


@query("U36", None)
def blake_hashes(t: Tables):
    """Blake2b digests; SQL has no such function."""
    return t.texts.select("doc_id", C.hash_text("text", "blake2b", "pepper").alias("digest"), C.hash_text("text", "sha512").alias("sha512"))


@query("U37", "SELECT doc_id, text AS decrypted, true AS sealed, true AS wrong_password_fails FROM documents")
def encryption_round_trip(t: Tables):
    sealed = t.documents.select("doc_id", "text", C.encrypt_text("text", "secret", b"salt").alias("token"))
    return sealed.select("doc_id", C.decrypt_text("token", "secret", b"salt").alias("decrypted"),
                         (~F.contains("token", "text") & (F.length("token") > F.length("text"))).alias("sealed"),
                         C.decrypt_text("token", "Secret", b"salt").isNull().alias("wrong_password_fails"))


# ----------------------------------------------------------------------- hosts

@query("A27 A28", f"""
WITH {D.LOG_SQL},
s AS (SELECT host, count(*) AS requests, count(*) FILTER (status BETWEEN 200 AND 299) AS successes, count(*) FILTER (status = 502) AS total_502,
  count(*) FILTER (status >= 500) AS server_errors FROM log GROUP BY host),
f AS (SELECT host, avg(response_ms) AS m FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, seq DESC) AS rn FROM log WHERE status BETWEEN 200 AND 299) WHERE rn <= 50 GROUP BY host)
SELECT s.*, round(coalesce(m, 0), 6) AS avg_response_ms, round(successes / requests, 6) AS success_rate,
  concat_ws('|', CASE WHEN total_502 > 10 THEN '检测到大量502错误，建议降低下载速度或更换下载时间' END, CASE WHEN successes / requests < 0.8 THEN '成功率较低，建议检查网络连接或服务器状态' END,
    CASE WHEN coalesce(m, 0) > 50 THEN '服务器响应较慢，建议增加超时时间或降低并发数' END) AS advice FROM s LEFT JOIN f USING (host)""")
def host_statistics(t: Tables):
    out = stats.host_statistics(D.request_log(t))
    advice = stats.host_advice("total_502", "success_rate", F.col("avg_response_ms") / 5, F.lit(True))
    return (out.withColumn("advice", F.array_join(advice, "|")).withColumn("avg_response_ms", F.round("avg_response_ms", 6))
            .withColumn("success_rate", F.round("success_rate", 6)))


HOST_HEALTH_SQL = f"""
WITH RECURSIVE {D.LOG_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS k FROM log),
w AS (
  SELECT host, k, seq, CASE WHEN status = 502 THEN 1 ELSE 0 END AS run, false AS bad FROM n WHERE k = 1
  UNION ALL
  SELECT n.host, n.k, n.seq, CASE WHEN n.status = 502 THEN w.run + 1 WHEN n.status BETWEEN 200 AND 299 THEN 0 ELSE greatest(w.run - 1, 0) END,
    w.bad OR (n.status = 502 AND w.run + 1 >= 3)
  FROM w JOIN n ON n.host = w.host AND n.k = w.k + 1)
SELECT host, seq, CAST(run AS INTEGER) AS run_502, bad AS unhealthy FROM w"""


@query("W14", HOST_HEALTH_SQL)
def host_health(t: Tables):
    """The 502 run of every host over its requests in order."""
    out = alerts.host_health(D.request_log(t))
    return out.select("host", "seq", "run_502", "unhealthy")


def admission_sql(rows: str, key: str, rate: str, capacity: float) -> str:
    """W13 request by request."""
    return f"""
WITH RECURSIVE r AS ({rows}), n AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, seq) AS k FROM r),
w AS (
  SELECT n.*, {capacity}::DOUBLE AS tokens FROM n WHERE k = 1
  UNION ALL
  SELECT n.*, least({capacity}::DOUBLE, w.tokens - CASE WHEN w.tokens >= w.need THEN w.need ELSE 0 END + (n.us - w.us) / 1e6 * ({rate})) AS tokens
  FROM w JOIN n ON n.{key} = w.{key} AND n.k = w.k + 1)
SELECT {key}, ts, seq, need, tokens >= need AS admitted, tokens - CASE WHEN tokens >= need THEN need ELSE 0 END AS tokens_left,
  CASE WHEN tokens >= need THEN 0.0 ELSE (need - tokens) / ({rate}) END AS wait_seconds FROM w"""


_REQUESTS = "SELECT event_type, ts, event_id AS seq, CAST(1 AS INTEGER) AS need FROM events"


RATE_ADMISSION_SQL = admission_sql(_REQUESTS, "event_type", "1::DOUBLE / 1200", 4.0)


@query("W13", RATE_ADMISSION_SQL)
def rate_admission(t: Tables):
    """Token bucket per event type: one token every 20 minutes, four at most."""
    r = t.events.select("event_type", "ts", F.col("event_id").alias("seq"), F.lit(1).alias("need"))
    return alerts.token_bucket(r, ["event_type"], 1 / 1200, 4.0)


@query("W13", admission_sql("""SELECT user_id, ts, event_id AS seq, CAST(1 + event_id % 3 AS BIGINT) AS need FROM events""", "user_id", "1::DOUBLE / 86400", 3.0))
def user_admission(t: Tables):
    """Token bucket per user: a token a day, three at most, one to three for an event; most pauses cut a session."""
    r = t.events.select("user_id", "ts", F.col("event_id").alias("seq"), (1 + F.col("event_id") % 3).alias("need"))
    return alerts.token_bucket(r, ["user_id"], 1 / 86400, 3.0)
