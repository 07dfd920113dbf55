"""Queries over ``pages``: urls, links, page records and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import markup as M
from ..functions import urls as U
from ..operators import extraction as X
from ..operators import planning, stats
from ..operators.joins import with_url_status
from ..sources import readers, writers
from . import derived as D
from . import sqltext as S
from .registry import Tables, query

_URL = "url"


def _links(t: Tables):
    return X.page_links(t.html_pages)


# ----------------------------------------------------------------------- urls

@query("U1 U2 U3 U4 U5 U6 U7 U27", f"""
SELECT page_id, {S.scheme(_URL)} <> '' AND {S.netloc(_URL)} <> '' AS absolute,
  regexp_matches(trim(url), '^(https?://|/)') AS prefixed,
  regexp_matches(lower({S.path(_URL)}), '\\.(jpg|jpeg|png|webp|gif|html|htm|php|asp|aspx)$')
    OR NOT contains({S.base(S.path(_URL))}, '.') OR ends_with({S.path(_URL)}, '/') AS crawlable,
  {S.netloc(_URL)} AS domain,
  concat({S.site(_URL)}, {S.path(_URL)}, CASE WHEN {S.query(_URL)} <> '' THEN concat('?', {S.query(_URL)}) ELSE '' END) AS without_fragment,
  {S.keep_key_params(_URL)} AS with_key_params,
  lower(regexp_replace(concat({S.site(_URL)}, {S.path(_URL)}), '/$', '')) AS folded,
  {S.html_path(S.path(_URL))} AS html_page
FROM pages""")
def url_profile(t: Tables):
    return t.pages.select(
        "page_id", U.is_absolute("url").alias("absolute"), U.has_url_prefix("url").alias("prefixed"),
        U.is_crawlable("url").alias("crawlable"), U.netloc("url").alias("domain"),
        U.drop_fragment("url").alias("without_fragment"), U.keep_key_params("url").alias("with_key_params"),
        U.fold_url("url").alias("folded"), U.is_html_page("url").alias("html_page"))


# what each odd form of a supplier's address must become
@query("U8 U22 U25 U26 U28 U43", """
WITH s AS (SELECT s_suppkey, concat('h', s_suppkey, '.example.com') AS h, CAST(s_suppkey AS VARCHAR) AS k FROM supplier)
SELECT s_suppkey, concat('https://', h, '/a') AS cleaned, concat(h, '/p') AS cleaned_bare,
  concat('http://', h, '/p?x=', k, '&y=2') AS preprocessed, concat('http://', h, '/p') AS preprocessed_bare,
  concat('http://', h, '/%C3%BC/', k, '?q=a+b#f') AS reencoded, true AS same_host, false AS same_host_exact, false AS other_host,
  s_suppkey % 2 = 0 AS current_page, s_suppkey % 3 <> 0 AS numbered_page FROM s""")
def odd_urls(t: Tables):
    k = F.col("s_suppkey").cast("string")
    h = F.concat(F.lit("h"), k, F.lit(".example.com"))
    rows = t.supplier.select(
        "s_suppkey", F.concat(F.lit("  //"), h, F.lit("/a \n")).alias("spaced"), F.concat(h, F.lit("/p")).alias("bare"),
        F.concat(F.lit("http://"), h, F.lit("/p?x=1&y=2&x="), k).alias("repeated"),
        F.concat(F.lit("http://"), h, F.lit("/ü/"), k, F.lit("?q=a b#f")).alias("accented"),
        F.concat(F.lit("http://"), F.upper(h), F.lit("/q")).alias("loud"), F.concat(F.lit("http://x"), h, F.lit("/p")).alias("other"),
        F.concat(F.lit("http://"), h, F.when(F.col("s_suppkey") % 2 == 0, "/p#top").otherwise("/p2")).alias("near"),
        F.concat(F.lit("http://"), h, F.lit("/g/a"), F.when(F.col("s_suppkey") % 3 == 0, "x").when(F.col("s_suppkey") % 3 == 1, "_").otherwise(""),
                 k, F.lit(".html")).alias("page"), F.concat(F.lit("http://"), h, F.lit("/g/a.html")).alias("first_page"))
    return rows.select(
        "s_suppkey", U.clean_url("spaced").alias("cleaned"), U.clean_url("bare").alias("cleaned_bare"),
        U.preprocess("repeated").alias("preprocessed"), U.preprocess("bare").alias("preprocessed_bare"),
        U.reencode("accented").alias("reencoded"), U.same_domain("repeated", "loud", True).alias("same_host"),
        U.same_domain("repeated", "loud").alias("same_host_exact"), U.same_domain("repeated", "other", True).alias("other_host"),
        U.is_current_page("near", F.concat(F.lit("http://"), "bare")).alias("current_page"),
        U.is_numbered_page("page", "first_page").alias("numbered_page"))


@query("U4 A30", f"""
WITH {S.ANCHORS}
SELECT {S.netloc('link')} AS domain, count(*) AS links, count(DISTINCT link) AS distinct_links,
       count(DISTINCT page_id) AS pages FROM anchors GROUP BY 1""")
def domain_counts(t: Tables):
    links = _links(t).select(U.netloc("url").alias("domain"), "url", "page_id")
    return links.groupBy("domain").agg(F.count("*").alias("links"), F.count_distinct("url").alias("distinct_links"),
                                       F.count_distinct("page_id").alias("pages"))


@query("U12 U13 U14", f"""
WITH n AS (SELECT page_id, url, regexp_extract_all(url, '([0-9]+)', 1) AS nums FROM pages),
near AS (SELECT page_id, 'neighbour' AS kind, CAST(i AS BIGINT) AS i,
    CASE WHEN len(nums) = 0 THEN url ELSE concat(left(url, instr(url, nums[-1]) - 1), CAST(i AS VARCHAR),
      substr(url, instr(url, nums[-1]) + length(nums[-1]))) END AS made
  FROM n, generate_series(5, 8) AS g(i) WHERE len(nums) > 0 OR i = 5),
flat AS (SELECT page_id, url, CAST(regexp_extract({S.path(_URL)}, '([0-9]+)', 1) AS BIGINT) AS first,
    regexp_replace({S.path(_URL)}, '[0-9]+', regexp_extract({S.path(_URL)}, '([0-9]+)', 1), 'g') AS p
  FROM pages WHERE regexp_matches({S.path(_URL)}, '[0-9]')),
sib AS (SELECT page_id, 'sibling' AS kind, CAST(i AS BIGINT) AS i,
    concat({S.site(_URL)}, replace(p, CAST(first AS VARCHAR), CAST(first + i AS VARCHAR))) AS made
  FROM flat, generate_series(0, 3) AS g(i))
SELECT page_id, kind, CASE WHEN kind = 'neighbour' THEN i - 5 ELSE i END AS i, made FROM (FROM near UNION ALL FROM sib)""")
def url_neighbours(t: Tables):
    near = t.pages.select("page_id", F.lit("neighbour").alias("kind"), F.posexplode(U.neighbour_urls("url", 5, 8)).alias("i", "made"))
    sib = t.pages.select("page_id", F.lit("sibling").alias("kind"), F.posexplode(U.sibling_urls("url", 4)).alias("i", "made"))
    return near.unionByName(sib).withColumn("i", F.col("i").cast("bigint"))


_N = "CAST(s_suppkey AS VARCHAR)"


@query("U16 U17 V5", f"""
WITH p AS (SELECT s_suppkey, concat('http://s', {_N}, '.example.com/a', CAST(s_suppkey + 20 AS VARCHAR), '.html') AS base_url FROM supplier),
x AS (
  SELECT s_suppkey, base_url, 1 AS index, i AS url_index, concat('http://s', {_N}, '.example.com/p', CAST(CASE WHEN i <= 3 THEN i ELSE i + 4 END AS VARCHAR), '_{{8-9}}.html') AS raw_url
  FROM p, generate_series(1, 5) AS g(i)
  UNION ALL
  SELECT s_suppkey, base_url, 2, i, concat('s.example.com/', ['red','blue'][i], '/', {_N}) FROM p, generate_series(1, 2) AS g(i)
  UNION ALL
  SELECT s_suppkey, base_url, 3, i, concat('http://s', CASE WHEN {_N} = CAST(s_suppkey + 20 AS VARCHAR) THEN '' ELSE {_N} END, '.example.com/a', CAST(s_suppkey + 20 + i - 6 AS VARCHAR), '.html')
  FROM p, generate_series(1, 11) AS g(i))
SELECT base_url, CAST(index AS BIGINT) AS index, CAST(url_index AS BIGINT) AS url_index, raw_url,
  CASE WHEN index = 2 THEN concat('http://', raw_url) ELSE raw_url END AS url,
  concat('set ', CAST(index AS VARCHAR), '-', CAST(url_index AS VARCHAR)) AS name, CAST(NULL AS VARCHAR) AS error
FROM x""")
def pattern_tasks(t: Tables):
    n = F.col("s_suppkey").cast("string")
    base = F.concat(F.lit("http://s"), n, F.lit(".example.com/a"), (F.col("s_suppkey") + 20).cast("string"), F.lit(".html"))
    host = F.concat(F.lit("http://s"), n, F.lit(".example.com/"))
    made = t.supplier.select(base.alias("base_url"), F.posexplode(F.array(
        F.concat(host, F.lit("p{1-3}_{8-9}.html")), F.concat(F.lit("s.example.com/{red, blue}/"), n),
        F.concat(host, F.lit("a*.html")))).alias("index", "pattern"))
    patterns = made.withColumn("index", F.col("index").cast("bigint") + 1)
    # the second range keeps its own numbers: 8 and 9 replace the first range in their turn
    out = planning.expanded_patterns(patterns, "set {index}-{url_index}")
    return out.select("base_url", "index", F.col("url_index").cast("bigint").alias("url_index"), "raw_url", "url", "name", "error")


# ---------------------------------------------------------------------- links

@query("S1", "SELECT page_id, url, false AS missing, CAST(length(html) AS BIGINT) AS chars FROM pages")
def page_source(t: Tables):
    rows = readers.pages(t.spark, f"{t.folder}/pages.parquet")
    return rows.select("page_id", "url", F.col("error_message").isNotNull().alias("missing"), F.length("html").cast("bigint").alias("chars"))


@query("H4 U9 U6", f"""
WITH {S.ANCHORS}
SELECT page_id, CAST(pos AS BIGINT) AS pos, link AS url, text, href AS original_href, {S.keep_key_params('link')} AS norm_url
FROM anchors""")
def link_inventory(t: Tables):
    return _links(t).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url", "text", "original_href",
                            U.keep_key_params("url").alias("norm_url"))


_PAGING = r"next|下一页|more|继续|page\s*[0-9]+|第\s*[0-9]+\s*页|>\s*$|»|→"
_EXCLUDED = ("login|logout|register|signup|signin|登录|注册|退出|登出|contact|about|privacy|terms|联系|关于|隐私|条款|"
             "rss|feed|xml|print|打印|share|分享|bookmark|收藏")
_PRIORITY_SQL = f"""
WITH {S.ANCHORS},
c AS (
  SELECT *, 'pagination' AS page_type, 0 AS branch,
    CASE WHEN regexp_matches(lower(text), 'next|下一页|下一|more') THEN 10 WHEN regexp_matches(text, '[0-9]') THEN 5 ELSE 3 END AS priority
  FROM anchors WHERE regexp_matches(lower(text), '{_PAGING}')
  UNION ALL
  SELECT *, 'category', 2, 5 FROM anchors WHERE {S.keep_key_params('link')} <> {S.keep_key_params('page_url')}),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, {S.keep_key_params('link')} ORDER BY priority DESC, branch, pos) AS rn FROM c),
kept AS (SELECT * FROM r WHERE rn = 1 AND NOT regexp_matches(lower(text), '{_EXCLUDED}')
  AND NOT regexp_matches(link, '(?i)#|javascript:|mailto:|tel:|\\.(pdf|doc|docx|xls|xlsx|zip|rar)$'))"""


@query("H11 H12 H13 H20 W3 F17 U2 U26 U38", _PRIORITY_SQL + """
SELECT page_id, link AS url, text AS link_text, page_type, CAST(priority AS BIGINT) AS priority FROM kept""")
def subpages_by_priority(t: Tables):
    rows = X.subpages_by_priority(t.html_pages)
    return rows.select("page_id", "url", "link_text", "page_type", F.col("priority").cast("bigint").alias("priority"))


@query("H20 W3 F17 U4", _PRIORITY_SQL + f"""
SELECT {S.netloc('link')} AS domain, page_type, count(*) AS links FROM kept GROUP BY ALL""")
def curated_domains(t: Tables):
    """The first query end to end: extract, resolve, normalise, rank, filter, count per domain."""
    rows = X.subpages_by_priority(t.html_pages)
    return rows.groupBy(U.netloc("url").alias("domain"), "page_type").agg(F.count("*").alias("links"))


@query("H1 H2 H3 U33", r"""
SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) AS title,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, lower(regexp_extract(html, '<meta charset="([^"]*)"', 1)) AS charset,
  regexp_extract(url, '//([^/?#]*)', 1) AS domain, CAST(NULL AS VARCHAR) AS summary, '' AS canonical_url, 0 AS og_entries
FROM pages""")
def page_info(t: Tables):
    rows = X.page_info(t.html_pages)
    return rows.select("page_id", "info.title", "info.language", F.lower("info.charset").alias("charset"), "info.domain",
                       "summary", "info.canonical_url", F.size("info.og_info").alias("og_entries"))


_FEW = "count(*) FILTER (tier) OVER (PARTITION BY page_id)"
_SECTIONS = "xiuren|xgyw|legbaby|huayang|youwu|missleg|tuigirl|mistar|aiyouwu"
_CONTENT = (r"(regexp_matches(lower(p), '/\w+[0-9]+\.html$|/\w+[0-9]+_[0-9]+\.html$|/\w+[0-9]+/$|/\w+[0-9]+_[0-9]+/$|/pic/[0-9]+/|/album/[0-9]+/|/gallery/[0-9]+/|/photos/[0-9]+/|"
            + _SECTIONS + r"') OR regexp_matches(p, '/_?[0-9]+(\.[^./]*)?$'))")


@query("H16 F14 F15 F16", f"""
WITH {D.ALBUM_SQL}, {S.ANCHORS}
SELECT page_id, link AS url, min(pos) AS pos FROM (SELECT *, {S.path('link')} AS p FROM anchors)
WHERE starts_with(href, '/') AND {_CONTENT} AND regexp_matches(lower(p), '{_SECTIONS}') AND regexp_matches(p, '[0-9]')
GROUP BY ALL""")
def relative_subpages(t: Tables):
    return X.relative_links(D.albums(t)).select("page_id", "url", F.col("pos").cast("bigint").alias("pos"))


@query("H18 U7 F18", f"""
WITH {D.ALBUM_SQL}, {S.ANCHORS},
f AS (SELECT DISTINCT page_id, page_url, lower(regexp_replace(concat({S.site('link')}, {S.path('link')}), '/$', '')) AS url FROM anchors)
SELECT page_id, url FROM f WHERE regexp_matches(url, '^https?://') AND {S.netloc('url')} = {S.netloc('page_url')}
  AND regexp_matches(url, '/[0-9]+\\.html$|page-[0-9]+|/[0-9]+/?')""")
def simple_subpages(t: Tables):
    return X.simple_subpages(D.albums(t)).select("page_id", "url")


@query("H21", """
SELECT page_id, (contains(h, '<img')::INT + contains(h, '.jpg')::INT + contains(h, '.jpeg')::INT + contains(h, '.png')::INT
  + contains(h, '.gif')::INT + contains(h, 'image/')::INT + contains(h, 'background-image')::INT + contains(h, 'src=')::INT
  + contains(h, 'data-src=')::INT) >= 2 AS has_images FROM (SELECT page_id, lower(html) AS h FROM pages)""")
def pages_with_images(t: Tables):
    return t.pages.select("page_id", M.has_images("html").alias("has_images"))


# ------------------------------------------------------------------ frontier

_PAGES_NUMBERED = "n AS (SELECT page_id, url, count(*) OVER () AS c FROM pages)"


@query("J4 X3 A30", """
WITH RECURSIVE c AS (SELECT count(*) AS c FROM pages),
edges AS (SELECT page_id AS src, (7 * page_id + k) % c.c AS dst FROM pages, c, generate_series(1, 2) AS g(k)),
walk(task, id, depth) AS (
  SELECT page_id, page_id, 0 FROM pages
  UNION
  SELECT task, dst, depth + 1 FROM walk JOIN edges ON id = src WHERE depth < 3)
SELECT CAST(task AS BIGINT) AS task, CAST(id AS BIGINT) AS url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY task, id""")
def crawl_frontier(t: Tables):
    """Three hops over the derived graph page n -> (7n + 1, 7n + 2) mod pages, from every page."""
    c = t.pages.agg(F.count("*").alias("c"))
    edges = t.pages.select("page_id").join(F.broadcast(c)).select(
        F.col("page_id").alias("src"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), "c").select(
        "src", ((F.col("src") * 7 + F.col("k")) % F.col("c")).alias("dst"))
    seeds = t.pages.select(F.col("page_id").alias("task"), F.col("page_id").alias("url"))
    return planning.frontier(seeds, edges, 3).select("task", "url", F.col("depth").cast("bigint").alias("depth"))


# ---------------------------------------------------------------- statistics

# every third page is known as reachable, every ninth as missing
_STATUS_SQL = """status AS (SELECT min(page_id) AS page_id, url, 'text/html' AS content_type,
  CASE WHEN min(page_id) % 9 = 0 THEN 404 ELSE 200 END AS status FROM pages GROUP BY url)"""


def _status(t: Tables):
    return t.pages.groupBy("url").agg(F.min("page_id").alias("page_id")).select(
        "url", F.when(F.col("page_id") % 9 == 0, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"))


@query("F43 A26", f"""
WITH {_STATUS_SQL},
found AS (SELECT concat({S.site('url')}) AS base_url, url FROM pages UNION ALL SELECT {S.site('url')}, concat(url, 'x') FROM pages)
SELECT base_url, count(*) AS subpages, CAST(0 AS BIGINT) AS images,
  count(*) FILTER (s.status = 200) AS valid_subpages, CAST(0 AS BIGINT) AS valid_images
FROM found LEFT JOIN status s USING (url) GROUP BY base_url""")
def crawl_statistics(t: Tables):
    site = F.concat(U.scheme("url"), F.lit("://"), U.netloc("url")).alias("base_url")
    found = t.pages.select(site, "url").unionByName(t.pages.select(site, F.concat("url", F.lit("x")).alias("url")))
    rows = with_url_status(found, _status(t)).withColumn("kind", F.lit("subpage")).withColumn("valid", F.col("valid_url"))
    return stats.crawl_statistics(rows)


@query("K4", f"""
WITH {S.ANCHORS},
f AS (SELECT page_url AS base_url, link AS url, length(text) > 4 AS valid FROM anchors),
d AS (SELECT DISTINCT * FROM f),
s AS (SELECT base_url, count(*) AS n, count(*) FILTER (valid) AS ok FROM d GROUP BY base_url),
lines AS (
  SELECT base_url, 0 AS part, unnest([0, 1]) AS n, unnest(['=== 页面爬取报告 ===', concat('目标URL: ', base_url)]) AS line FROM s
  UNION ALL SELECT base_url, 1, unnest([0, 1, 2, 3, 4, 5]), unnest(['', '=== 子页面 ===', concat('发现子页面: ', n, ' 个'), concat('有效子页面: ', ok, ' 个'), '', '子页面列表:']) FROM s
  UNION ALL SELECT base_url, 2, row_number() OVER (PARTITION BY base_url ORDER BY url), concat(row_number() OVER (PARTITION BY base_url ORDER BY url), '. ', url, ' [', CASE WHEN valid THEN '有效' ELSE '无效' END, ']') FROM d
  UNION ALL SELECT base_url, 3, unnest([0, 1, 2, 3]), unnest(['', '=== 图片资源 ===', '发现图片: 0 个', '有效图片: 0 个']) FROM s
  UNION ALL SELECT base_url, 6, unnest([0, 1, 2, 3]), unnest(['', '=== 统计 ===', concat('子页面有效率: ', printf('%.1f', ok * 100.0::DOUBLE / n), '%'), '图片有效率: N/A']) FROM s)
SELECT base_url, CAST(part AS BIGINT) AS part, CAST(n AS BIGINT) AS n, line FROM lines""")
def crawl_report(t: Tables):
    found = _links(t).select(F.col("page_url").alias("base_url"), "url", (F.length("text") > 4).alias("valid")).distinct()
    lines = writers.crawl_report(found.withColumn("kind", F.lit("subpage")))
    return lines.select("base_url", F.col("part").cast("bigint").alias("part"), "n", "line")


@query("K5 U11", r"""
WITH r AS (SELECT page_id, url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, CAST(page_id AS VARCHAR) AS title FROM pages)
SELECT concat('page_ ', title, '.txt') AS filename,
  concat('页面标题: page: ', title, chr(10), '原始链接: ', url, chr(10), '提取时间: 2024-01-31 00:00:00', chr(10), chr(10),
         '—————— 套图描述 ——————', chr(10), chr(10), 'language ', lang) AS body FROM r""")
def page_descriptions(t: Tables):
    rows = X.page_info(t.html_pages).select(
        "info.url", F.concat(F.lit("page: "), F.col("page_id").cast("string")).alias("title"),
        F.concat(F.lit(" language "), "info.language").alias("description"))
    return writers.page_descriptions(rows, "2024-01-31 00:00:00").select("filename", "body")


@query("U15 F22 T4 T5", r"""
WITH seeds AS (SELECT c_nationkey AS main, CAST(c_custkey AS VARCHAR) AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer),
gen AS (SELECT main, concat('http://n', CAST(main AS VARCHAR), '.example.com/set', CAST(k::BIGINT + i AS VARCHAR), '.html') AS url, pos, i
        FROM seeds, generate_series(0, 19) AS g(i) WHERE pos < 3),
once AS (SELECT main, url, min(pos * 100 + i) AS place FROM gen GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY main ORDER BY place) - 1 AS pos FROM once),
head AS (SELECT *, pos < 30 AND place % 3 = 0 AS keep FROM ranked WHERE pos < 50),
checked AS (SELECT * FROM (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY main) AS n FROM head) WHERE keep OR (pos >= 30 AND n < 10)),
found AS (SELECT main, concat('http://n', CAST(main AS VARCHAR), '.example.com/found', k, '.html') AS url, pos FROM seeds WHERE pos < main % 30),
counts AS (SELECT main, count(*) AS f FROM found GROUP BY main),
u AS (SELECT main, url, 0 AS tier, pos FROM found UNION ALL
      SELECT main, url, 1, pos FROM checked LEFT JOIN counts USING (main) WHERE coalesce(f, 0) < 15)
SELECT CAST(main AS BIGINT) AS main_url, url, CAST(tier AS BIGINT) AS tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY main ORDER BY tier, pos) AS rank FROM u) WHERE rank <= 30""")
def planned_pages(t: Tables):
    """Main-page analysis per nation: found pages, generated and checked ones, the page limit."""
    from ..operators import ordered as O
    n = F.concat(F.lit("http://n"), F.col("main_url").cast("string"), F.lit(".example.com/"))
    k = F.col("c_custkey").cast("string")
    seeds = O.numbered(t.customer.select(F.col("c_nationkey").cast("bigint").alias("main_url"), "c_custkey"),
                       ["main_url"], ["c_custkey"], "pos").withColumn("pos", F.col("pos") - 1)
    made = planning.generated_pages(seeds.select("main_url", "pos", F.concat(n, F.lit("set"), k, F.lit(".html")).alias("url")))
    ranked = O.numbered(made.withColumn("at", F.col("pos") * 100 + F.col("i")).drop("pos"), ["main_url"], ["at"], "pos")
    ranked = ranked.withColumn("pos", F.col("pos") - 1).withColumn("valid", F.col("at") % 3 == 0)
    checked = planning.checked_pages(ranked).select("main_url", "url", "pos")
    found = seeds.filter(F.col("pos") < F.col("main_url") % 30).select(
        "main_url", F.concat(n, F.lit("found"), k, F.lit(".html")).alias("url"), "pos")
    out = planning.limited_pages(found, checked, 30)
    return out.select("main_url", "url", F.col("tier").cast("bigint").alias("tier"), F.col("rank").cast("bigint").alias("rank"))
