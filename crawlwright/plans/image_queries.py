"""Queries over image candidates, file listings and gallery pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import links as L
from ..functions import markup as M
from ..functions import urls as U
from ..operators import curation, dedupe, joins, scan, stats
from ..operators import extraction as X
from . import derived as D
from . import sqltext as S
from .registry import Tables, query

# ------------------------------------------------------------- candidate urls

_EXT = r"lower(regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '\.([^.]*)$', 1))"


@query("U10 U18 U21 U29 U30 U31 U32 U34", rf"""
WITH {D.IMAGES_SQL}
SELECT image_id, CASE WHEN contains(filename, '.') THEN filename END AS filename,
  CASE WHEN {_EXT} IN ('jpg','jpeg','png','gif','webp','bmp','svg','ico') THEN {_EXT} ELSE '' END AS extension,
  concat('image_', left(md5(url), 8), CASE WHEN contains(url, '.jpg') THEN '.jpg' WHEN contains(url, '.jpeg') THEN '.jpeg'
    WHEN contains(url, '.png') THEN '.png' WHEN contains(url, '.gif') THEN '.gif' WHEN contains(url, '.webp') THEN '.webp'
    WHEN contains(url, '.bmp') THEN '.bmp' ELSE '.jpg' END) AS hashed_name,
  regexp_matches(lower(url), 'jpg|jpeg|png|webp|gif') OR NOT contains(filename, '.') AS content_image,
  {_EXT} IN ('jpg','jpeg','png','gif','webp','bmp') OR regexp_matches(url, '(?i)\.(svg|ico)$|/images?/|/img/|/photos?/|/pics?/|/gallery/|/media/') AS rich_image,
  regexp_matches(lower(url), '\.(jpg|jpeg|png|gif|webp|bmp)$|/images/|/img/|/photo/') AS simple_image,
  regexp_matches(lower(url), '\.(jpg|jpeg|png|gif|webp|bmp|tiff|svg)$') AS validated_image,
  image_id * 3 + 10 AS hint_width, CAST(trunc(p_w) AS BIGINT) AS parsed,
  CASE content_type WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' ELSE '' END AS mime_extension
FROM (SELECT *, image_id / 2 AS p_w FROM images)""".replace("image_id * 3 + 10 AS hint_width",
    "CASE WHEN image_id * 3 + 10 <= 10000 THEN image_id * 3 + 10 END AS hint_width"))
def image_names(t: Tables):
    px = F.concat((F.col("image_id") / 2).cast("string"), F.lit("px"))
    sized = F.concat(F.lit("/s/"), (F.col("image_id") * 3 + 10).cast("string"), F.lit("x600.png"))
    return D.images(t).select(
        "image_id", U.filename_from_url("url").alias("filename"), U.file_extension("url").alias("extension"),
        U.hashed_image_name("url").alias("hashed_name"), U.is_image_url("url").alias("content_image"),
        U.is_image_url("url", "rich").alias("rich_image"), U.is_image_url("url", "simple").alias("simple_image"),
        U.is_image_url("url", "validated").alias("validated_image"), U.size_hint(sized)["width"].alias("hint_width"),
        U.parse_dimension(px).cast("bigint").alias("parsed"), U.mime_extension("content_type").alias("mime_extension"))


@query("U11 U19 U20 U35", r"""
WITH x AS (SELECT p_partkey, concat(p_name, ':', p_brand, '?.', lower(p_type)) AS dirty,
    concat('http://www.g', CAST(p_size AS VARCHAR), '.example.com/Set/Set', CAST(p_partkey AS VARCHAR), '_2.html') AS url FROM part)
SELECT p_partkey, regexp_replace(dirty, '[:?]', '_', 'g') AS download_name, regexp_replace(dirty, '[:?]', '_', 'g') AS validated_name,
  regexp_replace(dirty, '[:?]', '_', 'g') AS plain_name,
  CASE WHEN p_partkey < 1 THEN 'Set0' ELSE concat('Set', CAST(p_partkey AS VARCHAR)) END AS archive_directory,
  concat('Set', CAST(p_partkey AS VARCHAR), '_2') AS task_directory,
  CASE WHEN p_partkey * 700 = 0 THEN '未知' WHEN p_partkey * 700 < 1024 THEN concat(CAST(p_partkey * 700 AS VARCHAR), ' B')
       WHEN p_partkey * 700 < 1048576 THEN printf('%.1f KB', p_partkey * 700 / 1024) ELSE printf('%.1f MB', p_partkey * 700 / 1048576) END AS size_text,
  concat(lpad(CAST(p_partkey // 3600 AS VARCHAR), 2, '0'), ':', lpad(CAST(p_partkey % 3600 // 60 AS VARCHAR), 2, '0'), ':',
         lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0')) AS clock_text,
  ['⏳ 等待中', '⬇️ 下载中', '✅ 已完成', '❌ 失败', '🚫 已取消', '❓ 未知'][p_partkey % 6 + 1] AS status_text
FROM x""")
def file_names(t: Tables):
    dirty = F.concat("p_name", F.lit(":"), "p_brand", F.lit("?."), F.lower("p_type"))
    url = F.concat(F.lit("http://www.g"), F.col("p_size").cast("string"), F.lit(".example.com/Set/Set"),
                   F.col("p_partkey").cast("string"), F.lit("_2.html"))
    states = F.array(*map(F.lit, ["waiting", "downloading", "completed", "failed", "cancelled", "lost"]))
    x = t.part.select("p_partkey", dirty.alias("dirty"), url.alias("url"),
                      F.get(states, (F.col("p_partkey") % 6).cast("int")).alias("status"))
    return x.select(
        "p_partkey", U.sanitize_filename("dirty").alias("download_name"),
        U.sanitize_filename("dirty", "validated").alias("validated_name"), U.sanitize_filename("dirty", "plain").alias("plain_name"),
        U.directory_name("url").alias("archive_directory"), U.task_directory("url").alias("task_directory"),
        U.human_size(F.col("p_partkey") * 700).alias("size_text"), U.clock("p_partkey").alias("clock_text"),
        U.status_label("status").alias("status_text"))


# ---------------------------------------------------------------- rule filters

_HINT = "NULL"
_SCORED = rf"""scored AS (
  SELECT *, coalesce(width, 0) AS w, coalesce(height, 0) AS h FROM images),
q AS (SELECT *, least(1.0::DOUBLE, 0.5::DOUBLE
    + CASE WHEN w * h >= 2073600 THEN 0.2::DOUBLE WHEN w * h >= 921600 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN w > 0 AND h > 0 AND w / h BETWEEN 0.5 AND 2.0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN regexp_matches(filename, 'high|hd|large|big') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN length(trim(alt_text)) > 5 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN regexp_matches(lower(url), 'original|full|large|high') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM scored),
x AS (SELECT *, lower(concat_ws(' ', url, filename, alt_text, title, css_class, element_id)) AS txt,
    regexp_extract(lower(url), '\.(jpg|jpeg|png|gif|webp|bmp|svg|ico)$', 1) AS e FROM q),
r AS (SELECT *, list_filter([
    CASE WHEN w > 0 AND w < 100 THEN concat('宽度过小: ', w, ' < 100') WHEN h > 0 AND h < 100 THEN concat('高度过小: ', h, ' < 100')
         WHEN w > 2500 THEN concat('宽度过大: ', w, ' > 2500') WHEN h > 10000 THEN concat('高度过大: ', h, ' > 10000') END,
    CASE WHEN file_size > 0 AND file_size < 1024 THEN concat('文件过小: ', file_size, ' < 1024')
         WHEN file_size > 52428800 THEN concat('文件过大: ', file_size, ' > 52428800') END,
    CASE WHEN e = 'svg' THEN '不支持的格式: svg' END,
    CASE WHEN contains(txt, 'avatar') THEN '包含阻止的关键词: avatar' WHEN contains(txt, 'icon') THEN '包含阻止的关键词: icon'
         WHEN contains(txt, 'logo') THEN '包含阻止的关键词: logo' WHEN contains(txt, 'banner') THEN '包含阻止的关键词: banner'
         WHEN contains(txt, 'ad') THEN '包含阻止的关键词: ad' END,
    CASE WHEN starts_with(url, 'http://h3.') THEN '来自阻止的域名: h3.example' END,
    CASE WHEN score < 0.6 THEN printf('质量评分过低: %.2f < 0.6', score) END], lambda z: z IS NOT NULL) AS reasons FROM x)"""
_RULES = {"max_width": 2500, "blocked_domains": ["h3.example"], "min_quality_score": 0.6}


@query("F5 F6 F7 F8 F9 F10 F11 F12 F13 U39", f"""
WITH {D.IMAGES_SQL}, {_SCORED}
SELECT image_id, round(score, 6) AS score, array_to_string(reasons, ' | ') AS reasons, len(reasons) = 0 AS passed FROM r""")
def image_filter_reasons(t: Tables):
    rows = curation.apply_rules(D.images(t), _RULES)
    return rows.select("image_id", F.round("score", 6).alias("score"), F.array_join("reasons", " | ").alias("reasons"), "passed")


@query("A1", f"""
WITH {D.IMAGES_SQL}, {_SCORED}
SELECT count(*) AS total_images, count(*) FILTER (len(reasons) = 0) AS passed_images, count(*) FILTER (len(reasons) > 0) AS failed_images,
  count(*) FILTER (score >= 0.8::DOUBLE) AS high, count(*) FILTER (score >= 0.5::DOUBLE AND score < 0.8::DOUBLE) AS medium,
  count(*) FILTER (score < 0.5::DOUBLE) AS low FROM r""")
def filter_statistics(t: Tables):
    return stats.filter_statistics(curation.apply_rules(D.images(t), _RULES))


@query("A1", f"""
WITH {D.IMAGES_SQL}, {_SCORED}
SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason""")
def filter_reason_counts(t: Tables):
    return stats.reason_counts(curation.apply_rules(D.images(t), _RULES))


_SMALL = r"\.gif$|thumb|small|icon|logo|btn|button|nav|menu|banner|_s\.|_m\.|_t\.|mm[0-9]+\."
_LARGE_SQL = rf"""CASE WHEN contains(u, '/pic/') THEN regexp_matches(u, '/pic/[0-9]+\.(jpg|jpeg|png|webp)$')
    WHEN contains(u, '/uploadfile/') AND (ends_with(u, '.webp') OR NOT regexp_matches(u, '{_SMALL}')) THEN true
    WHEN regexp_matches(u, '/uploadfile/[0-9]{{4,6}}/[0-9]{{1,4}}/|\.webp$|\.jpg$|\.jpeg$|\.png$|large|big|original|full')
      THEN NOT regexp_matches(u, '{_SMALL}|ad') ELSE true END"""


@query("F1 F2 F3 F4 F21", rf"""
WITH {D.IMAGES_SQL}, x AS (SELECT *, lower(url) AS u FROM images),
y AS (SELECT image_id, {_LARGE_SQL} AS large, NOT regexp_matches(filename, 'logo|icon|btn|button|nav|menu|ad|banner') AS plain_name,
  NOT coalesce(width < 800 OR height < 600, false) OR width IS NULL OR height IS NULL AS content_size FROM x)
SELECT *, large AND plain_name AND content_size AS kept, false AS skipped_by_path FROM y""")
def large_image_split(t: Tables):
    return D.images(t).select(
        "image_id", I.is_large("url").alias("large"), I.has_plain_name("filename").alias("plain_name"),
        I.has_content_size("width", "height").alias("content_size"),
        I.passes_three_levels("url", "filename", "width", "height").alias("kept"), I.skipped_by_path("url").alias("skipped_by_path"))


@query("W2 W1", f"""
WITH {D.IMAGES_SQL}, x AS (SELECT image_id, page_url, regexp_extract(filename, '^([a-z]+-[a-z]+)', 1) AS filename, url FROM images)
SELECT image_id, page_url, filename, url FROM (SELECT *, row_number() OVER (
  PARTITION BY CASE WHEN filename <> '' THEN 0 ELSE 1 END, CASE WHEN filename <> '' THEN lower(filename) ELSE url END ORDER BY image_id) AS rn FROM x) WHERE rn = 1""")
def image_dedupe(t: Tables):
    rows = D.images(t).select("image_id", "page_url", F.regexp_extract("filename", "^([a-z]+-[a-z]+)", 1).alias("filename"), "url")
    return dedupe.dedupe_images(rows, ["image_id"])


@query("F23", f"""
WITH {D.IMAGES_SQL}
SELECT coalesce(CASE WHEN file_size < 51200 OR file_size > 10485760 THEN 'size'
  WHEN file_size IS NOT NULL AND (coalesce(width < 800, false) OR coalesce(height < 600, false)) THEN 'resolution' END, 'kept') AS reason,
  count(*) AS n FROM images GROUP BY 1""")
def prefilter_counts(t: Tables):
    return curation.prefilter_counts(D.images(t))


@query("T7 F23", f"""
WITH {D.IMAGES_SQL}
SELECT image_id, url, file_size FROM images WHERE NOT (coalesce(file_size < 51200 OR file_size > 10485760, false)
  OR (file_size IS NOT NULL AND (coalesce(width < 800, false) OR coalesce(height < 600, false))))""")
def images_to_download(t: Tables):
    return curation.sort_images(curation.prefiltered(D.images(t))).select("image_id", "url", "file_size")


@query("J1 U42", f"""
WITH {D.IMAGES_SQL}, {D.FILES_SQL},
x AS (SELECT image_id, concat('d', CAST(image_id % 50 AS VARCHAR)) AS dir, concat(regexp_extract(filename, '^([a-z]+-[a-z]+-[0-9]+)', 1), '.png') AS filename FROM images)
SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.dir = x.dir AND f.filename = x.filename AND f.length > 0 AND f.length BETWEEN 100 AND 52428800)""")
def existing_antijoin(t: Tables):
    x = D.images(t).select("image_id", F.concat(F.lit("d"), (F.col("image_id") % 50).cast("string")).alias("dir"),
                           F.concat(F.regexp_extract("filename", "^([a-z]+-[a-z]+-[0-9]+)", 1), F.lit(".png")).alias("filename"))
    return joins.without_existing_files(x, D.files(t)).select("image_id", "dir", "filename")


# ----------------------------------------------------------------------- files

@query("A7 T8", f"""
WITH {D.FILES_SQL}
SELECT dir, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, first(filename ORDER BY length DESC, filename) AS largest_file, max(length) AS largest_size
FROM files GROUP BY dir""")
def directory_statistics(t: Tables):
    return stats.directory_statistics(D.files(t))


@query("A7", f"""
WITH {D.FILES_SQL}
SELECT dir, lower(regexp_extract(filename, '[^.](\\.[^.]+)$', 1)) AS ext, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM files GROUP BY ALL""")
def extension_statistics(t: Tables):
    return stats.extension_statistics(D.files(t))


@query("A8", f"""
WITH {D.FILES_SQL}, x AS (SELECT *, lower(regexp_extract(filename, '[^.]\\.([^.]+)$', 1)) AS ext FROM files)
SELECT ext, count(*) AS n, min(filename) AS first_file FROM x WHERE ext <> '' GROUP BY ext""")
def files_by_type(t: Tables):
    return stats.files_by_type(D.files(t)).groupBy("ext").agg(F.count("*").alias("n"), F.min("filename").alias("first_file"))


@query("F38 J7", f"""
WITH {D.FILES_SQL}, x AS (SELECT concat(dir, '/', filename) AS path FROM files)
SELECT path, 'sensitive_file' AS kind, 'medium' AS level, concat('sensitive_file_', left(md5(path), 8)) AS issue_id FROM x
  WHERE regexp_matches(path, '\\.(pem|key|p12|pfx|env|secret)$')
UNION ALL SELECT path, 'backup_file', 'low', concat('backup_file_', left(md5(path), 8)) FROM x WHERE regexp_matches(path, '\\.(bak|backup|old|orig)$')""")
def sensitive_files(t: Tables):
    rows = D.files(t).select(F.concat("dir", F.lit("/"), "filename").alias("path"))
    return scan.scan_file_names(rows).select("path", "kind", "level", "issue_id")


# ------------------------------------------------------------- gallery pages

@query("F19 F20", """
SELECT p_partkey, p_size % 7 IN (1, 3) AS domain_allowed, p_size % 7 NOT IN (0, 2) AS domain_not_blocked, p_size % 4 < 2 AS known_format,
  p_size * 20 BETWEEN 100 AND 10000 AND p_size * 400 BETWEEN 100 AND 10000 AS valid_size FROM part""")
def domains_and_ranges(t: Tables):
    rest = F.col("p_size") % 7
    host = F.when(rest == 0, "").otherwise(F.concat(F.lit("g"), rest.cast("string"), F.lit(".example.com")))
    name = F.element_at(F.array(F.lit(".JPG"), F.lit("webp"), F.lit("..txt"), F.lit(None).cast("string")), (F.col("p_size") % 4 + 1).cast("int"))
    allowed, blocked = [f"g{k}.example.com" for k in (1, 2, 3)], ["g2.example.com"]
    return t.part.select("p_partkey", L.is_domain_allowed(host, allowed, blocked).alias("domain_allowed"),
                         L.is_domain_allowed(host, blocked=blocked).alias("domain_not_blocked"), I.is_supported_format(name).alias("known_format"),
                         I.is_valid_dimensions(F.col("p_size") * 20, F.col("p_size") * 400).alias("valid_size"))


@query("H5", f"""
WITH {D.GALLERY_SQL},
i AS (SELECT page_id, site, k, p_size, p_type, unnest([0, 1, 2, 3, 4]) AS pos FROM g)
SELECT page_id, CAST(pos AS BIGINT) AS pos,
  CASE pos WHEN 0 THEN concat(site, '/full/', k, '.jpg') WHEN 1 THEN concat(site, '/full/', k, '.jpg') WHEN 2 THEN 'data:image/png;base64,AAAA'
    WHEN 3 THEN concat(site, '/orig/', k, '.png') ELSE concat(site, '/img/logo', k, '.png') END AS url,
  CASE pos WHEN 0 THEN p_type ELSE '' END AS alt_text,
  CAST(CASE pos WHEN 0 THEN p_size * 60 ELSE 0 END AS BIGINT) AS width, CAST(CASE pos WHEN 0 THEN 900 ELSE 0 END AS BIGINT) AS height FROM i""")
def gallery_images(t: Tables):
    return X.page_images(D.galleries(t)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "url", "alt_text", F.col("width").cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"))


_CONTENT_SQL = """c AS (
  SELECT page_id, page_url, concat(site, '/full/', k, '.jpg') AS url, concat(k, '.jpg') AS filename, 0 AS pos, p_size * 60 AS width FROM g WHERE p_size * 60 >= 800
  UNION ALL SELECT page_id, page_url, concat(site, '/lazy/', k, '.webp'), concat(k, '.webp'), 2, NULL FROM g
  UNION ALL SELECT page_id, page_url, concat(site, '/orig/', k, '.png'), concat(k, '.png'), 3, NULL FROM g)"""


@query("H6 U29 U34 W1 F1", f"""
WITH {D.GALLERY_SQL}, {_CONTENT_SQL}
SELECT page_id, url, filename, CAST(pos AS BIGINT) AS pos, CAST(width AS BIGINT) AS width FROM c""")
def content_images(t: Tables):
    return X.content_images(D.galleries(t)).select("page_id", "url", "filename", F.col("pos").cast("bigint").alias("pos"),
                                                   F.col("width").cast("bigint").alias("width"))


_RICH_SQL = """t AS (SELECT page_id, 0 AS branch, unnest([0, 1, 2, 3, 4]) AS pos,
    unnest([concat(site, '/full/', k, '.jpg'), concat(site, '/full/', k, '.jpg'), concat(site, '/lazy/', k, '.webp'),
            concat(site, '/orig/', k, '.png'), concat(site, '/img/logo', k, '.png')]) AS url FROM g),
  css AS (SELECT page_id, 1 AS branch, unnest([0, 1]) AS pos, unnest([concat(site, '/css/', CAST(p_size AS VARCHAR), '.png'), concat(site, '/bg/', k, '.gif')]) AS url FROM g),
  l AS (SELECT page_id, 2 AS branch, 4 AS pos, concat(site, '/big/', k, '.jpeg') AS url FROM g)"""


@query("H7", f"""
WITH {D.GALLERY_SQL}, {_RICH_SQL} SELECT page_id, CAST(pos AS BIGINT) AS pos, url FROM t""")
def rich_tag_images(t: Tables):
    return X.rich_tag_images(D.galleries(t)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url")


@query("H8", f"""
WITH {D.GALLERY_SQL}, {_RICH_SQL} SELECT page_id, CAST(pos AS BIGINT) AS pos, url FROM css""")
def css_images(t: Tables):
    return X.css_images(D.galleries(t)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url")


@query("H9", f"""
WITH {D.GALLERY_SQL}, {_RICH_SQL} SELECT page_id, url, 'Large' AS link_text FROM l""")
def link_images(t: Tables):
    return X.link_images(D.galleries(t)).select("page_id", "url", "link_text")


@query("H10 W1 X1", f"""
WITH {D.GALLERY_SQL}, {_RICH_SQL}
SELECT page_id, url, CAST(min(branch) AS BIGINT) AS branch FROM (FROM t UNION ALL FROM css UNION ALL FROM l) GROUP BY page_id, url""")
def all_images(t: Tables):
    return X.all_images(D.galleries(t)).select("page_id", "url", F.col("branch").cast("bigint").alias("branch"))


@query("H19 A30", f"""
WITH {D.GALLERY_SQL}, {_RICH_SQL}
SELECT DISTINCT page_id, url FROM (SELECT page_id, url FROM t WHERE NOT contains(url, '/lazy/') AND NOT contains(url, '/orig/') UNION ALL SELECT page_id, url FROM css WHERE pos = 1)""")
def simple_images(t: Tables):
    return X.simple_images(D.galleries(t)).select("page_id", "url")


@query("H14 F14 F15", f"""
WITH {D.GALLERY_SQL} SELECT page_id, concat(site, '/Xiuren/Xiuren', unnest([k, k1]), '.html') AS url FROM g""")
def container_links(t: Tables):
    return X.container_links(D.galleries(t)).select("page_id", "url")


@query("H15 F14", f"""
WITH {D.GALLERY_SQL} SELECT page_id, concat(site, '/g/', k, unnest(['_2', '_3']), '.html') AS url FROM g WHERE p_partkey % 4 = 0""")
def pagination_region_links(t: Tables):
    return X.pagination_region_links(D.galleries(t)).select("page_id", "url")


# /cat/N.html, /rel/N.html: numeric names are content links; the paging links end in digits too
_SUBPAGES_SQL = f"""base AS (
  SELECT page_id, site, p_partkey, unnest([concat('/Xiuren/Xiuren', k, '.html'), concat('/Xiuren/Xiuren', k1, '.html')]) AS p FROM g
  UNION ALL SELECT page_id, site, p_partkey, concat('/g/', k, unnest(['_2', '_3']), '.html') FROM g WHERE p_partkey % 4 = 0
  -- a root-relative link whose name is the page's name and more digits is a numbered page
  UNION ALL SELECT page_id, site, p_partkey, concat('/cat/', CAST(p_size AS VARCHAR), '.html') FROM g
            WHERE starts_with(CAST(p_size AS VARCHAR), k) AND CAST(p_size AS VARCHAR) <> k),
n AS (SELECT page_id, count(*) AS n FROM base GROUP BY page_id),
sub AS (SELECT page_id, concat(site, p) AS url FROM base)"""


@query("H16 H17 F16 X2", f"""
WITH {D.GALLERY_SQL}, {_SUBPAGES_SQL},
same AS (SELECT page_id, concat(site, '/g/', k, '.html') AS url FROM g WHERE p_partkey % 4 = 0)
SELECT page_id, url FROM sub UNION SELECT page_id, url FROM same""")
def subpages(t: Tables):
    """Containers, paging and relative links; same-directory links where those are few."""
    return X.subpages(D.galleries(t)).select("page_id", "url")


@query("H12 H13", f"""
WITH {D.GALLERY_SQL}
SELECT page_id, concat(site, '/rel/', CAST(p_partkey % 10 AS VARCHAR), '.html') AS url, 'related' AS page_type, CAST(unnest([0, 7]) AS BIGINT) AS selector FROM g
UNION ALL SELECT page_id, concat(site, '/cat/', CAST(p_size AS VARCHAR), '.html'), 'category', 0 FROM g""")
def region_links(t: Tables):
    g = D.galleries(t)
    return X.related_links(g).unionByName(X.category_links(g)).select(
        "page_id", "url", "page_type", F.col("selector").cast("bigint").alias("selector"))


@query("H22 H23 H21", f"""
WITH {D.GALLERY_SQL}, {_CONTENT_SQL}
SELECT g.page_id, p_name || ' ' || k AS title, true AS parsed, CAST(2 + (p_size * 60 >= 800)::INT AS BIGINT) AS images,
  CAST(CASE WHEN p_partkey % 4 = 0 THEN 5 ELSE 2 END + (starts_with(CAST(p_size AS VARCHAR), k) AND CAST(p_size AS VARCHAR) <> k)::INT AS BIGINT) AS sub_pages, true AS has_images FROM g""")
def page_records(t: Tables):
    g = D.galleries(t)
    rows = X.page_records(g).join(g.select("page_id", M.has_images("html").alias("has_images")), "page_id")
    return rows.select("page_id", "title", "parsed", F.size("images").cast("bigint").alias("images"),
                       F.size("sub_pages").cast("bigint").alias("sub_pages"), "has_images")
