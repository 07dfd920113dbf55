"""Extraction on the markup cases the given pages do not hold."""

import pytest

from crawlwright.operators import extraction as X

PAGE = "https://h.example/Xiuren/Xiuren10.html"


def rows(spark, fn, html, *cols, url=PAGE):
    df = spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in fn(df).orderBy(*[c for c in ("branch", "pos", "url")
            if c in fn(df).columns]).collect()]


def test_lazy_and_data_uri(spark):
    assert rows(spark, X.page_images, '<img src="" data-original="/a/b.jpg">', "url") == ["https://h.example/a/b.jpg"]
    assert rows(spark, X.rich_tag_images, '<img src="data:x" data-src="c.webp">', "url") == ["https://h.example/Xiuren/c.webp"]


def test_duplicates_and_hidden_images(spark):
    html = '<img src="/u/1.jpg"><!-- <img src="/u/2.jpg"> --><script>var a="<img src=/u/3.jpg>"</script><img src="/u/1.jpg">'
    assert rows(spark, X.content_images, html, "url", "pos") == [("https://h.example/u/1.jpg", 0)]


def test_css(spark):
    html = "<style>a{background:url('bg.png')}</style><div style=\"background:url(x.gif)\"></div>"
    assert rows(spark, X.css_images, html, "url") == ["https://h.example/Xiuren/bg.png", "https://h.example/Xiuren/x.gif"]
    assert rows(spark, X.simple_images, html, "url") == ["https://h.example/Xiuren/x.gif"]


def test_containers(spark):
    links = '<a href="/Xiuren/Xiuren11.html">a</a><a href="http://ads.example/x.html">ad</a>'
    both = f'<section class="container">{links}</section><div class="container"><a href="/Xiuren/Xiuren12.html">b</a></div>'
    assert rows(spark, X.container_links, both, "url") == ["https://h.example/Xiuren/Xiuren11.html"]
    only = '<div class="big container"><a href="/Xiuren/Xiuren12.html">b</a></div>'
    assert rows(spark, X.container_links, only, "url") == ["https://h.example/Xiuren/Xiuren12.html"]


def test_pagination_region(spark):
    html = ('<ul class="pagination"><a href="/x/9.html">9</a></ul><div class="pagination"><a class="current" href="/x/1.html">1</a>'
            '<a href="/x/2.html">2</a><a href="/x/3.html">3</a><a href="/x/2.html">下一页</a></div>')
    assert rows(spark, X.pagination_region_links, html, "url") == ["https://h.example/x/2.html", "https://h.example/x/3.html"]


@pytest.mark.parametrize("tiers,neighbours", [(2, 3), (5, 0)])
def test_few_links_open_the_neighbour_tier(spark, tiers, neighbours):
    tier = "".join(f'<a href="/Xiuren/Xiuren{20 + i}.html">x</a>' for i in range(tiers))
    near = "".join(f'<a href="sub{i}9.html">y</a>' for i in range(3))
    html = f'<section class="container">{tier}</section>{near}'
    assert len(rows(spark, X.subpages, html, "url")) == tiers + neighbours


def test_priority_keeps_the_best_and_then_filters(spark):
    html = '<nav><a href="/c?id=1">login</a></nav><a href="/c?id=1">next</a><div class="related"><a href="/d">dog</a></div>'
    got = rows(spark, X.subpages_by_priority, html, "url", "page_type", "priority")
    assert got == [("https://h.example/c?id=1", "pagination", 10), ("https://h.example/d", "related", 7)]
    worse = '<nav><a href="/c?id=1">fine</a></nav><a href="/c?id=1">next login</a>'
    assert rows(spark, X.subpages_by_priority, worse, "url") == []


def test_meta(spark):
    html = ('<html lang="de"><head><meta name="Description" content="d"><meta property="og:description" content=" og ">'
            '<meta name="language" content="en"><link rel="canonical" href="/c"><meta http-equiv="Content-Type" content="text/html; charset=GBK">'
            '<title> A &amp; <b>B</b> </title></head></html>')
    df = spark.createDataFrame([(1, PAGE, html)], "page_id bigint, url string, html string")
    r = X.page_info(df).collect()[0]
    assert (r["info"]["title"], r["info"]["language"], r["info"]["charset"]) == ("A & B", "de", "gbk")
    assert r["info"]["canonical_url"] == "https://h.example/c" and r["info"]["og_info"] == {"og:description": " og "}
    assert r["summary"] == "og"


def test_broken_markup_and_missing_pages(spark):
    html = '<p>open<script>var t="</p><a href=\'/s\'>s</a>";</script><!-- <a href="/c">c</a> --><a href=/ok>o<b>k</b></a>'
    assert rows(spark, X.page_links, html, "url", "text") == [("https://h.example/ok", "ok")]
    df = spark.createDataFrame([(1, PAGE, None), (2, PAGE, html)], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["parsed"], r["error_message"]) for r in X.page_records(df).collect()}
    assert got == {1: (False, "no content"), 2: (True, None)}


def test_relative_and_simple_links(spark):
    html = ('<a href="/Xiuren/Xiuren11.html">a</a><a href="//cdn.example/Xiuren/Xiuren12.html">b</a><a href="/about.html">c</a>'
            '<a href="/Xiuren/Xiuren11.html">again</a><a href="/n/77.html#x">d</a><a href="http://other.example/n/78.html">e</a>')
    assert rows(spark, X.relative_links, html, "url", "pos") == [("https://h.example/Xiuren/Xiuren11.html", 0)]
    assert rows(spark, X.simple_subpages, html, "url") == ["https://h.example/n/77.html"]


def test_albums_over_all_cores(spark):
    """Pages made from a small table are spread like galleries; they are many times as large as its rows."""
    from crawlwright.plans import derived, registry
    pages = derived.albums(registry.Tables(spark, "/root/testdata/sf0.001"))
    assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_region_tiers_read_pages_once(spark):
    """Pages without a region have no link in one and are not split for it."""
    df = spark.createDataFrame([(1, "https://h.example/n/1.html", "<a href='/Xiuren/Xiuren1.html'>a</a>"), (2, None, None),
                                (None, "https://h.example/n/2.html", "<div class='container'><a href='/Xiuren/Xiuren2.html'>a</a></div>")],
                               "page_id long, url string, html string")
    for links, want in ((X.container_links, [(None, "https://h.example/Xiuren/Xiuren2.html")]), (X.pagination_region_links, [])):
        found = links(df)
        assert [(r.page_id, r.url) for r in found.collect()] == want
        assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
