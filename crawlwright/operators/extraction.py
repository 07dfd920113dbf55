"""Page extraction: links, images, sub-pages and page records from HTML.

Input is a table ``(page_id, url, html)``. ``html`` is read once, projected to
tag attributes in the scan stage and never shuffled. Only pages whose markup
mentions a wanted region go through a Python worker, because only there the
nesting of tags matters.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import images as I
from ..functions import links as L
from ..functions import markup as M
from ..functions import urls as U
from .columns import computed
from .dedupe import dedupe_by_priority, keep_first

# Selectors, in order, and the tier limit.
RELATED_SELECTORS = [".related", ".similar", ".recommend", ".more", "#related", "#similar", "#recommend",
                     "[class*=related]", "[class*=similar]", "[class*=recommend]"]
CATEGORY_SELECTORS = ["nav", ".nav", ".navigation", ".menu", ".category", ".categories", "#nav",
                      "#navigation", "#menu", "[class*=nav]", "[class*=menu]", "[class*=category]"]
FEW_LINKS = 5
CURRENT_CLASS = "current"
NEXT_PAGE_TEXT = "下一页"
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

ANCHOR_SCHEMA = (
    "page_id bigint, url string, pos int, href string, text string, title string, css_class string, "
    "element_id string, container string, pagination int, "
    "ancestors array<struct<tag:string,css_class:string,id:string,ord:int>>")


BASE = {p: f"base_{p}" for p in U.URL_PARTS}


def with_base(pages: DataFrame) -> DataFrame:
    """Add the split page url as flat columns, so that it is split once per page."""
    return pages.select("*", F.inline(F.array(U.url_parts("url"))).alias(*BASE.values()))


def base() -> dict[str, Column]:
    """The split page url of a row, as :func:`urls.join_parts` takes it."""
    return {p: F.col(c) for p, c in BASE.items()}


# ------------------------------------------------------------------- anchors

def anchors(pages: DataFrame) -> DataFrame:
    """Every ``a`` tag with its attributes and text, in document order."""
    found = F.transform(M.pieces(M.visible("html"), "a"), lambda p: F.struct(
        M.attributes(p).alias("attrs"), M.inner_text(p, "a").alias("text")))
    tags = with_base(pages).select("page_id", "url", *BASE.values(), F.posexplode(found).alias("pos", "tag"))
    a = F.col("tag.attrs")
    return tags.select(
        "page_id", "url", *BASE.values(), "pos", M.attr(a, "href").alias("href"), F.col("tag.text").alias("text"),
        M.attr_text(a, "title").alias("title"), M.attr_text(a, "rel").alias("rel"),
        M.attr_text(a, "target").alias("target"), M.attr_text(a, "class").alias("css_class"),
        M.attr_text(a, "id").alias("element_id")).filter("href is not null")


class _AnchorParser(HTMLParser):
    """Collects anchors together with the open elements around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []
        self.found: list[dict] = []
        self.count = 0
        self.section = False
        self.regions: dict[int, int] = {}

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        css, el_id = at.get("class", ""), at.get("id", "")
        words = css.split()
        self.count += 1
        self.section |= tag == "section" and "container" in words
        for rank, hit in enumerate((tag == "div" and "pagination" in words, tag == "ul" and "pagination" in words,
                                    tag == "div" and el_id == "pagination")):
            if hit:
                self.regions.setdefault(rank, self.count)
        record = None
        if tag == "a" and "href" in at:
            record = {"href": at["href"], "text": [], "title": at.get("title", ""), "css_class": css,
                      "element_id": el_id,
                      "ancestors": [e[:4] for e in self.open]}
            self.found.append(record)
        if tag not in VOID_TAGS:
            self.open.append((tag, css, el_id, self.count, record))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for e in self.open:
            if e[4] is not None:
                e[4]["text"].append(data)


_PAGES_PER_PART = 1024


def _parse_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, _PAGES_PER_PART):
            yield _parsed(batch.slice(first, _PAGES_PER_PART))


def _parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The anchors of some pages; ancestors are built as flat columns, not as an object per element."""
    page, rows, ends, above = [], [], [0], []
    for at, text in enumerate(batch.column(2)):
        parser = _AnchorParser()
        parser.feed(text.as_py() or "")
        parser.close()
        region = parser.regions[min(parser.regions)] if parser.regions else None
        container = "section" if parser.section else "div"
        for pos, r in enumerate(parser.found):
            page.append(at)
            rows.append((pos, r["href"], "".join(r["text"]).strip(), r["title"], r["css_class"], r["element_id"], container, region))
            above.extend(r["ancestors"])
            ends.append(len(above))
    column = lambda items, k, kind: pa.array([x[k] for x in items], kind)
    kinds = [("tag", pa.string()), ("css_class", pa.string()), ("id", pa.string()), ("ord", pa.int32())]
    ancestors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [column(above, k, kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds]))
    own = [batch.column(k).take(pa.array(page, pa.int64())) for k in range(2)]
    return pa.RecordBatch.from_arrays(
        [own[0].cast(pa.int64()), own[1].cast(pa.string()), column(rows, 0, pa.int32()), *[column(rows, k, pa.string()) for k in range(1, 7)],
         column(rows, 7, pa.int32()), ancestors],
        names=["page_id", "url", "pos", "href", "text", "title", "css_class", "element_id", "container", "pagination", "ancestors"])


def scoped_anchors(pages: DataFrame, mentions: str, others: bool = True) -> DataFrame:
    """Anchors with their ancestors; pages that do not mention a region stay in the JVM, or are left out."""
    wanted = F.coalesce(F.col("html").rlike(mentions), F.lit(False))
    inside = pages.filter(wanted).select("page_id", "url", "html").mapInArrow(_parse_anchors, ANCHOR_SCHEMA)
    if not others:
        return with_base(inside)
    none = "array<struct<tag:string,css_class:string,id:string,ord:int>>"
    outside = anchors(pages.filter(~wanted)).select(
        "page_id", "url", "pos", "href", "text", "title", "css_class", "element_id",
        F.lit("div").alias("container"), F.lit(None).cast("int").alias("pagination"),
        F.array().cast(none).alias("ancestors"))
    return with_base(inside.unionByName(outside))


def _selects(selector: str, e: Column) -> Column:
    if selector.startswith("."):
        return F.array_contains(F.split(e["css_class"], r"\s+"), selector[1:])
    if selector.startswith("#"):
        return e["id"] == selector[1:]
    if selector.startswith("[class*="):
        return e["css_class"].contains(selector[8:-1])
    return e["tag"] == selector


def page_links(pages: DataFrame) -> DataFrame:
    """H4: all links but empty and fragment ones; duplicates stay."""
    href = U.strip("href")
    a = anchors(pages).withColumn("href", href).filter((F.col("href") != "") & ~F.col("href").startswith("#"))
    a = computed(a.withColumnRenamed("url", "page_url"), url=U.join_parts(base(), "href"))
    return a.select("page_id", "page_url", *BASE.values(), "pos", "url", "text", "title", "rel", "target",
                    F.col("href").alias("original_href"))


_LINK_COLS = ["page_id", "page_url", "url", "link_text", "title", "page_type", "priority",
              "branch", "selector", "element", "pos"]
_HITS = "array<struct<branch:int,page_type:string,priority:int,selector:int,element:int>>"
_PAGINATION, _RELATED, _CATEGORY = 0, 1, 2


def _hit(branch: int, page_type: str, priority: Column, selector: int, element: Column) -> Column:
    return F.struct(F.lit(branch).alias("branch"), F.lit(page_type).alias("page_type"), priority.alias("priority"),
                    F.lit(selector).alias("selector"), element.alias("element"))


def pagination_hits() -> Column:
    """H11 on an anchor row: one hit or none."""
    one = F.array(_hit(_PAGINATION, "pagination", L.pagination_priority("text", "title"), 0, F.lit(0)))
    return F.when(L.is_pagination("text", "title", "href"), one).otherwise(F.array()).cast(_HITS)


def region_hits(selectors: list[str], page_type: str, branch: int) -> Column:
    """H12 and H13 on an anchor row: one hit per selector and element it lies in."""
    priority = L.type_priority(F.lit(page_type))
    def hits(i, s):
        return F.transform(F.filter(F.col("ancestors"), lambda e: _selects(s, e)),
                           lambda e: _hit(branch, page_type, priority, i, e["ord"]))
    return F.flatten(F.array(*[hits(i, s) for i, s in enumerate(selectors)])).cast(_HITS)


def _hit_links(a: DataFrame) -> DataFrame:
    """Absolute, same-host links, one row per hit; only paging links may lead to the page itself.

    All kinds of hits of an anchor come from one pass over the anchor table.
    """
    a = a.withColumn("href", U.strip("href")).filter("href <> ''").withColumnRenamed("text", "link_text").withColumnRenamed(
        "url", "page_url")
    a = a.select("page_id", "page_url", *BASE.values(), "pos", "href", "link_text", "title", F.explode("_hits").alias("hit"))
    a = computed(a, url=U.join_parts(base(), "href"))
    same = U.has_url_prefix("url") & (F.lower(U.netloc("url")) == F.lower(F.col(BASE["netloc"])))
    kept = a.filter(same & ((F.col("hit.branch") == _PAGINATION) | ~U.is_current_page("url", "page_url")))
    return kept.select("*", "hit.*").select(_LINK_COLS)


def _with_hits(a: DataFrame, hits: Column) -> DataFrame:
    return computed(a, _hits=hits).filter(F.size("_hits") > 0)


def pagination_links(pages: DataFrame) -> DataFrame:
    """H11."""
    return _hit_links(_with_hits(anchors(pages), pagination_hits()))


def _mentions(selectors: list[str]) -> str:
    words = sorted({s.strip(".#[]").removeprefix("class*=") for s in selectors})
    return "(?i)" + "|".join(words)


def related_links(pages: DataFrame) -> DataFrame:
    """H12."""
    hits = region_hits(RELATED_SELECTORS, "related", _RELATED)
    return _hit_links(_with_hits(scoped_anchors(pages, _mentions(RELATED_SELECTORS), False), hits))


def category_links(pages: DataFrame) -> DataFrame:
    """H13."""
    hits = region_hits(CATEGORY_SELECTORS, "category", _CATEGORY)
    return _hit_links(_with_hits(scoped_anchors(pages, _mentions(CATEGORY_SELECTORS), False), hits))


def subpages_by_priority(pages: DataFrame) -> DataFrame:
    """Pagination, related and category links, de-duplicated by priority."""
    a = scoped_anchors(pages, _mentions(RELATED_SELECTORS + CATEGORY_SELECTORS))
    hits = F.concat(pagination_hits(), region_hits(RELATED_SELECTORS, "related", _RELATED),
                    region_hits(CATEGORY_SELECTORS, "category", _CATEGORY))
    return dedupe_by_priority(_hit_links(_with_hits(a, hits)))


def _in_box() -> Column:
    return F.exists("ancestors", lambda e: (e["tag"] == F.col("container"))
                    & F.array_contains(F.split(e["css_class"], r"\s+"), "container"))


def _in_paging() -> Column:
    return F.coalesce(F.exists("ancestors", lambda e: e["ord"] == F.col("pagination")), F.lit(False))


def _tiers(a: DataFrame, sections: list[str], tiers: tuple[str, ...] = ("in_container", "in_pagination", "relative", "neighbour")) -> DataFrame:
    """Absolute links with the tests of the sub-page tiers."""
    a = computed(a, link=U.join_parts(base(), "href"))
    a = computed(a, link_path=U.path("link"), link_host=U.netloc("link"))
    at = {"path": F.col("link_path"), "host": F.col("link_host")}
    a = computed(a, content=L.is_content_link("link", sections, at),
                 contained=L.is_container_link("link", base(), sections, at))
    current = F.array_contains(F.split("css_class", r"\s+"), CURRENT_CLASS)
    href = F.col("href")
    tests = dict(
        in_container=_in_box() & (href != "") & F.col("content") & F.col("contained"),
        in_pagination=_in_paging() & ~current & ~F.col("text").contains(NEXT_PAGE_TEXT) & F.col("content"),
        relative=(href.startswith("/") & ~href.startswith("//") & ~href.contains("://") & F.col("content")
                  & F.col("contained")),
        neighbour=L.is_neighbour_page("link", base(), at) & F.col("content"),
    )
    return computed(a, **{t: tests[t] for t in tiers}).select("page_id", "url", "pos", "link", *tiers)


_TIER_MENTIONS = "(?i)container|pagination"


def _tier_links(pages: DataFrame, flag: str, inside: Column, sections: list[str]) -> DataFrame:
    """Links of one tier; only anchors ``inside`` its region, which no page has without mentioning it, are resolved and tested."""
    rows = _tiers(scoped_anchors(pages, _TIER_MENTIONS, False).filter(inside), sections, (flag,)).filter(flag)
    return keep_first(rows.select("page_id", F.col("url").alias("page_url"), F.col("link").alias("url"), "pos"),
                      ["page_id", "url"], ["pos"])


def container_links(pages: DataFrame, sections: list[str] = L.SECTIONS) -> DataFrame:
    """Links in section.container, or in div.container where no section has the class."""
    return _tier_links(pages, "in_container", _in_box(), sections)


def pagination_region_links(pages: DataFrame, sections: list[str] = L.SECTIONS) -> DataFrame:
    """Links of the first paging region, without current and next."""
    return _tier_links(pages, "in_pagination", _in_paging(), sections)


def relative_links(pages: DataFrame, sections: list[str] = L.SECTIONS) -> DataFrame:
    """Root-relative links; no nesting needed, so always JVM-side."""
    a = anchors(pages)
    href = F.col("href")
    rows = computed(a.filter(href.startswith("/") & ~href.startswith("//") & ~href.contains("://")),
                    link=U.join_parts(base(), "href"))
    rows = computed(rows, link_path=U.path("link"), link_host=U.netloc("link"))
    at = {"path": F.col("link_path"), "host": F.col("link_host")}
    rows = rows.filter(L.is_content_link("link", sections, at) & L.is_container_link("link", base(), sections, at))
    return keep_first(rows.select("page_id", F.col("url").alias("page_url"), F.col("link").alias("url"), "pos"),
                      ["page_id", "url"], ["pos"])


def subpages(pages: DataFrame, sections: list[str] = L.SECTIONS, few: int = FEW_LINKS) -> DataFrame:
    """Container, paging and relative links; neighbours only where those are fewer than five.

    One shuffle by page serves both the distinct and the per-page count.
    """
    tier = F.col("in_container") | F.col("in_pagination") | F.col("relative")
    rows = _tiers(scoped_anchors(pages, _TIER_MENTIONS), sections).select(
        "page_id", "url", "link", tier.alias("tier"), "neighbour").filter("tier or neighbour")
    per_link = rows.repartition("page_id").groupBy("page_id", "url", "link").agg(
        F.bool_or("tier").alias("tier"))
    count = F.count_if("tier").over(Window.partitionBy("page_id"))
    return (per_link.withColumn("n", count).filter(F.col("tier") | (F.col("n") < few))
            .select("page_id", F.col("url").alias("page_url"), F.col("link").alias("url")))


def simple_subpages(pages: DataFrame) -> DataFrame:
    """Folded same-host links that end in a number; distinct."""
    href = U.strip("href")
    a = anchors(pages).withColumn("href", href).filter((F.col("href") != "") & ~F.col("href").startswith("#"))
    a = computed(computed(a, full=U.join_parts(base(), "href")), link=U.fold_url("full"))
    rows = a.filter(L.is_simple_subpage("link", F.col(BASE["netloc"])))
    return rows.select("page_id", F.col("url").alias("page_url"), F.col("link").alias("url")).distinct()


# -------------------------------------------------------------------- images

def image_tags(pages: DataFrame) -> DataFrame:
    """Every ``img`` tag with its attributes, in document order."""
    rows = with_base(pages).select(
        "page_id", "url", *BASE.values(), F.posexplode(M.tag_attributes(M.visible("html"), "img")).alias("pos", "attrs"))
    return rows


def page_images(pages: DataFrame) -> DataFrame:
    """H5: all images with src or the first lazy attribute."""
    a = F.col("attrs")
    lazy = F.coalesce(*[F.nullif(M.attr(a, n), F.lit("")) for n in M.LAZY_SRC_ATTRS[1:]], F.lit(""))
    src = U.strip(M.attr_text(a, "src"))
    rows = computed(image_tags(pages), src=F.when(src != "", src).otherwise(U.strip(lazy))).filter("src <> ''")
    return rows.select(
        "page_id", F.col("url").alias("page_url"), "pos", U.join_parts(base(), "src").alias("url"),
        M.attr_text(a, "alt").alias("alt_text"), M.attr_text(a, "title").alias("title"),
        U.parse_dimension(M.attr(a, "width")).alias("width"), U.parse_dimension(M.attr(a, "height")).alias("height"),
        M.attr_text(a, "class").alias("css_class"), F.col("src").alias("original_src"))


def _int_attr(value: Column) -> Column:
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), U.strip(value).try_cast("int"))


def content_images(pages: DataFrame, filtered: bool = True) -> DataFrame:
    """H6: first usable source of each img tag, first occurrence per url, then the three-level filter.

    Tests that depend on the url alone run before the de-duplication shuffle.
    """
    a, parts = F.col("attrs"), base()
    refs = F.filter(F.array(*[M.attr_text(a, n) for n in M.LAZY_SRC_ATTRS]), lambda v: v != "")
    urls = F.transform(refs, lambda v: U.join_parts(parts, v))
    rows = computed(image_tags(pages), picked=F.get(F.filter(urls, lambda u: U.is_image_url(u)), 0)).filter("picked is not null")
    rows = computed(rows, filename=U.filename_from_url("picked")).filter("filename is not null")
    w, h = M.attr(a, "width"), M.attr(a, "height")
    width = _int_attr(w)
    readable = w.isNull() | width.isNotNull()
    rows = rows.select(
        "page_id", F.col("url").alias("page_url"), "pos", F.col("picked").alias("url"),
        F.nullif(width, F.lit(0)).alias("width"),
        F.when(readable, F.nullif(_int_attr(h), F.lit(0))).alias("height"), "filename")
    if filtered:
        rows = rows.filter(I.has_plain_name("filename") & I.is_large("url"))
    first = keep_first(rows, ["page_id", "url"], ["pos"])
    if filtered:
        first = first.filter(I.has_content_size("width", "height"))
    return first.withColumn("file_type", F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1)))


def rich_tag_images(pages: DataFrame) -> DataFrame:
    """H7: first non-blank source of eight that is no data url; attributes and metadata map kept."""
    a = F.col("attrs")
    srcs = [F.when((U.strip(M.attr_text(a, n)) != "") & ~M.attr_text(a, n).startswith("data:"),
                   U.strip(M.attr(a, n))) for n in M.RICH_SRC_ATTRS]
    rows = computed(image_tags(pages), src=F.coalesce(*srcs)).filter("src is not null")
    rows = computed(rows, image_url=U.join_parts(base(), "src")).filter(U.is_image_url("image_url", "rich"))
    meta = ["loading", "decoding", "sizes", "srcset"]
    return rows.select(
        "page_id", F.col("url").alias("page_url"), F.lit(0).alias("branch"), "pos", F.col("image_url").alias("url"),
        U.strip(M.attr_text(a, "alt")).alias("alt_text"), U.strip(M.attr_text(a, "title")).alias("title"),
        U.parse_dimension(M.attr(a, "width")).alias("width"), U.parse_dimension(M.attr(a, "height")).alias("height"),
        M.attr_text(a, "class").alias("css_class"), M.attr_text(a, "id").alias("element_id"),
        F.map_from_arrays(F.array(*map(F.lit, meta)), F.array(*[M.attr_text(a, n) for n in meta])).alias("metadata"))


def css_urls(pages: DataFrame) -> DataFrame:
    """Urls in style sheets, then in style attributes, in document order."""
    shown = F.regexp_replace("html", M._COMMENTS, "")
    sheets = F.regexp_extract_all(shown, F.lit(r"(?is)<style(?:\s[^>]*)?>(.*?)(?:</style\s*>|\z)"), F.lit(1))
    return with_base(pages).select(
        "page_id", "url", *BASE.values(),
        F.posexplode(F.concat(
            F.transform(F.flatten(F.transform(sheets, lambda s: F.regexp_extract_all(s, F.lit(M.CSS_URL), F.lit(1)))),
                        lambda u: F.struct(F.lit("sheet").alias("kind"), u.alias("ref"))),
            F.transform(style_attribute_urls(M.visible("html"), M.CSS_URL),
                        lambda u: F.struct(F.lit("attribute").alias("kind"), u.alias("ref"))))).alias("pos", "hit"))


def style_attribute_urls(markup: Column, pattern: str) -> Column:
    """Urls in the style attributes of all tags, in document order."""
    return F.flatten(F.transform(M.styled_tags(markup), lambda a: F.regexp_extract_all(
        M.attr_text(a, "style"), F.lit(pattern), F.lit(1))))


def css_images(pages: DataFrame) -> DataFrame:
    """H8."""
    ref = U.strip("hit.ref")
    rows = css_urls(pages).withColumn("ref", ref).filter("ref <> '' and not startswith(ref, 'data:')")
    rows = computed(rows, image_url=U.join_parts(base(), "ref")).filter(U.is_image_url("image_url", "rich"))
    return rows.select("page_id", F.col("url").alias("page_url"), F.lit(1).alias("branch"), "pos",
                       F.col("image_url").alias("url"))


def link_images(pages: DataFrame) -> DataFrame:
    """H9: links whose target is an image."""
    a = anchors(pages).withColumn("href", U.strip("href")).filter("href <> ''")
    a = computed(a, link=U.join_parts(base(), "href")).filter(U.is_image_url("link", "rich"))
    return a.select("page_id", F.col("url").alias("page_url"), F.lit(2).alias("branch"), "pos",
                    F.col("link").alias("url"), F.col("text").alias("link_text"), "title")


def all_images(pages: DataFrame) -> DataFrame:
    """Tag, style and link images, first per url over the three in this order."""
    rows = rich_tag_images(pages).drop("metadata").unionByName(
        css_images(pages), allowMissingColumns=True).unionByName(
        link_images(pages).drop("link_text"), allowMissingColumns=True)
    return keep_first(rows, ["page_id", "url"], ["branch", "pos"])


def simple_images(pages: DataFrame) -> DataFrame:
    """Img src and style attribute urls; distinct."""
    tags = image_tags(pages).select("page_id", "url", *BASE.values(), U.strip(M.attr_text(F.col("attrs"), "src")).alias("ref"))
    styles = with_base(pages).select("page_id", "url", *BASE.values(), F.explode(
        style_attribute_urls(M.visible("html"), M.SIMPLE_CSS_URL)).alias("ref")).withColumn("ref", U.strip("ref"))
    rows = tags.filter("ref <> ''").unionByName(styles)
    rows = computed(rows, link=U.join_parts(base(), "ref")).filter(U.is_image_url("link", "simple"))
    return rows.select("page_id", F.col("url").alias("page_url"), F.col("link").alias("url")).distinct()


# ------------------------------------------------------------------- records

def page_info(pages: DataFrame) -> DataFrame:
    """H1 to H3, one row per page."""
    rows = computed(pages, metas=M.metas("html"))
    return rows.select("page_id", M.page_info("url", "html", F.col("metas")).alias("info"),
                       M.title("html").alias("title_or_null"), M.description(F.col("metas")).alias("summary"))


def page_records(pages: DataFrame, extract_images: bool = True, extract_subpages: bool = True,
                 filter_images: bool = True, sections: list[str] = L.SECTIONS) -> DataFrame:
    """Per page title, images, sub-pages, parsed flag and error.

    A page without markup stays as a row that is not parsed. The arrays are
    bounded by one page, so collecting them per page is safe.
    """
    out = pages.select(
        "page_id", "url", F.coalesce(M.title("html"), F.lit("")).alias("title"),
        F.col("html").isNotNull().alias("parsed"),
        F.when(F.col("html").isNull(), "no content").alias("error_message"))
    if extract_images:
        imgs = content_images(pages, filter_images).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(
            "pos", "url", "filename", "file_type", "width", "height"))).alias("images"))
        out = out.join(imgs, "page_id", "left")
    if extract_subpages:
        subs = subpages(pages, sections).groupBy("page_id").agg(F.array_sort(F.collect_set("url")).alias("sub_pages"))
        out = out.join(subs, "page_id", "left")
    return out
