import pytest
from pyspark.sql import functions as F

from crawlwright.functions import links as L
from crawlwright.functions import urls as U
from crawlwright.functions import validation as V
from crawlwright.operators import planning


def run(spark, rows, build):
    cols = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in cols))
    out = df.repartition(1).select(build(*[F.col(c) for c in cols]).alias("r")).collect()
    return [r["r"] for r in out]


def one(spark, args, build):
    return run(spark, [args], build)[0]


CASES = [
    (U.drop_fragment, ("https://h.example/a?x=1#t",), "https://h.example/a?x=1"),
    (U.keep_key_params, ("https://h.example/a?utm=1&Page=2&id=3&id=4",), "https://h.example/a?Page=2&id=3"),
    (U.keep_key_params, ("https://h.example/a?utm=1",), "https://h.example/a"),
    (U.fold_url, ("https://H.example/A/?q#f",), "https://h.example/a"),
    (U.preprocess, ("ex.com/a?x=1&y=&x=2#t",), "http://ex.com/a?x=2&y=#t"),
    (U.join_url, ("https://h.example/en/9.html", "../b/./c.jpg"), "https://h.example/b/c.jpg"),
    (U.join_url, ("https://h.example/en/9.html", "?page=3"), "https://h.example/en/9.html?page=3"),
    (U.join_url, ("https://h.example/en/9.html", "//cdn.example/x.png"), "https://cdn.example/x.png"),
    (U.join_url, ("https://h.example/en/9.html", "/x"), "https://h.example/x"),
    (U.join_url, ("https://h.example", "x"), "https://h.example/x"),
    (U.join_url, ("https://h.example/a/b", "mailto:a@b"), "mailto:a@b"),
    (U.join_url, ("https://h.example/a/b", "#top"), "https://h.example/a/b#top"),
    (U.join_url, ("https://h.example/a/b/", ".."), "https://h.example/a/"),
    (U.join_url, ("https://h.example/a/b/", "../../../c"), "https://h.example/c"),
    (U.filename_from_url, ("https://h.example/get?file=a%20b.jpg",), "a b.jpg"),
    (U.filename_from_url, ("https://h.example/x/a+b%20c.png?y=1",), "a+b c.png"),
    (U.filename_from_url, ("https://h.example/x/",), None),
    (U.netloc, ("http://u:p@H.example:80/x",), "u:p@H.example:80"),
    (U.clean_url, (" //h/x ",), "https://h/x"),
    (U.clean_url, (None,), ""),
    (U.file_extension, ("https://h.example/a.JPG?x#y",), "jpg"),
    (U.file_extension, ("https://h.example/a.html",), ""),
    (U.directory_name, ("https://h.example/Foo/Foo33896_1.html",), "Foo33896"),
    (U.directory_name, ("https://www.site.example.com/",), "site.example"),
    (U.task_directory, ("https://h.example/a/Foo12.html",), "Foo12"),
    (U.reencode, ("https://h.example/a b%20?q=1 2&x#f/",), "https://h.example/a%20b%2520?q=1+2&x#f%2F"),
    (U.human_size, ("1536",), "1.5 KB"),
    (U.human_size, ("0",), U.SIZE_UNKNOWN),
    (U.human_size, ("512",), "512 B"),
    (U.clock, ("3725",), "01:02:05"),
    (U.parse_dimension, (" 12.7PX",), 12),
    (U.parse_dimension, ("auto",), 0),
    (U.charset_of, ("text/html; Charset=UTF-8; x",), "utf-8"),
    (U.mime_extension, ("Image/SVG+xml",), "svg"),
    (U.url_similarity, ("http://a/abcdefghij", "http://a/abcdefghiX"), 0.9),
    (U.url_similarity, ("http://a/abc", "http://A/abc"), 0.0),
    (U.url_similarity, ("http://a/", "http://a/abc"), 0.5),
    (U.is_numbered_page, ("http://a/x/page_12.html", "http://a/x/page.html"), True),
    (U.is_numbered_page, ("http://a/x/page12b.html", "http://a/x/page.html"), False),
    (U.is_html_page, ("http://a/x/page.jpg",), False),
    (U.is_html_page, ("http://a/x/page",), True),
    (U.is_crawlable, ("http://a/x.JPEG",), True),
    (U.is_crawlable, ("/x.jpg",), False),
    (U.has_url_prefix, (" /x",), True),
    (U.has_url_prefix, ("",), False),
    (L.is_content_link, ("https://h.example/gallery/12/",), True),
    (L.is_content_link, ("https://ads.example/x/page12.html",), True),
    (L.is_content_link, ("https://ads.example/x/page",), False),
    (V.is_public_domain, ("http://192.168.1.20/image.jpg",), False),
    (V.is_public_domain, ("http://8.8.8.8/",), True),
    (V.is_public_domain, ("http://100.64.0.1/",), False),
    (V.is_public_domain, ("http://[::1]/",), False),
    (V.is_public_domain, ("http://[2606:4700::1111]/",), True),
    (V.is_public_domain, ("http://[fe80::1]/",), False),
    (V.is_public_domain, ("http://intranet/",), False),
]


@pytest.mark.parametrize("fn,args,expected", CASES, ids=[f"{c[0].__name__}-{i}" for i, c in enumerate(CASES)])
def test_case(spark, fn, args, expected):
    got = one(spark, args, lambda *c: fn(*c))
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def test_neighbours(spark):
    assert one(spark, ("https://h2.example/p2",), lambda u: U.neighbour_urls(u, 5, 6)) == [
        "https://h5.example/p2", "https://h6.example/p2"]
    assert one(spark, ("https://h.example/p",), lambda u: U.neighbour_urls(u, 5, 6)) == ["https://h.example/p"]


def test_siblings(spark):
    assert one(spark, ("https://h.example/a7/b8.html",), lambda u: U.sibling_urls(u, 2)) == [
        "https://h.example/a7/b7.html", "https://h.example/a8/b8.html"]


def patterns_of(spark, *rows):
    return spark.createDataFrame(rows, "base_url string, index long, pattern string")


def test_patterns(spark):
    def expand(base, pattern):
        rows = planning.pattern_urls(patterns_of(spark, (base, 1, pattern))).collect()
        assert sorted(r.position for r in rows) == list(range(len(rows)))
        return [r.raw_url for r in sorted(rows, key=lambda r: r.position)]
    assert expand("http://h/", "/p{1-2}_{5-6}") == ["/p1_{5-6}", "/p2_{5-6}", "/p5_{5-6}", "/p6_{5-6}"]
    assert expand("http://h/", "/p{9-1}{0-1}{1-99999999999999999999}") == [f"/p{i}{{0-1}}{{1-99999999999999999999}}" for i in (0, 1)]
    assert expand("http://h/", "/{a, b}/x") == ["/a/x", "/b/x"]
    assert expand("http://h/p8.html", "http://h/p*.html") == [f"http://h/p{i}.html" for i in range(3, 14)]
    assert expand("http://h/p8.html", "http://other/*") == ["http://other/*"]


def test_long_ranges(spark, monkeypatch):
    """Every number once, whatever the pieces; the first bad url stops its own pattern and no other."""
    monkeypatch.setattr(planning, "RANGE_PIECE", 7)
    rows = [("b", 1, "http://h/{5-404}/{7-7}{90-89}{0-50}"), (None, 2, "http://h/{0-49}"), (None, 2, "http://h/{0-49}"), ("b", 3, "{1-3000}"),
            ("b", 4, "ftp://h/{1-60}")]
    got = [tuple(r) for r in planning.expanded_patterns(patterns_of(spark, *rows)).select("index", "url_index", "raw_url", "error").collect()]
    tail = "/{7-7}{90-89}{0-50}"
    assert sorted(r[1:3] for r in got if r[0] == 1) == list(enumerate(
        (f"http://h/{i}{tail}" for i in [*range(5, 405), 7, *range(51)]), 1))
    assert sorted(r[2] for r in got if r[0] == 2) == sorted(f"http://h/{i}" for i in [*range(50)] * 2)
    for k in (3, 4):
        made = sorted(r for r in got if r[0] == k)
        assert [r[1] for r in made] == list(range(1, len(made) + 1)) and all(r[3] is None for r in made[:-1])
    assert planning.expanded_patterns(patterns_of(spark, *rows).limit(0)).count() == 0


def test_wide_range(spark):
    """A wide range spreads over the tasks and is no array in a row."""
    rows = planning.expanded_patterns(patterns_of(spark, ("b", 1, "http://h/{1-200000}.html")))
    assert tuple(rows.selectExpr("count(*)", "min(url_index)", "max(url_index)", "sum(url_index)", "count(error)").first()) == (
        200_000, 1, 200_000, 200_000 * 200_001 // 2, 0)


def test_size_hint(spark):
    assert one(spark, ("/5x5_800x600.jpg",), U.size_hint) is None
    hit = one(spark, ("/a/1024X768.jpg",), U.size_hint)
    assert (hit["width"], hit["height"]) == (1024, 768)


def test_filename_variants(spark):
    dirty = 'test<>:"|?*.jpg'
    for v in ("download", "validated", "plain"):
        assert one(spark, (dirty,), lambda c, v=v: U.sanitize_filename(c, v)) == "test_______.jpg"
    assert one(spark, ("con.tar.gz",), lambda c: U.sanitize_filename(c, "validated")) == "_con.tar.gz"
    assert one(spark, ("con.tar.gz",), lambda c: U.sanitize_filename(c)) == "con.tar.gz"
    assert one(spark, ("lpt1.txt",), U.sanitize_filename) == "_lpt1.txt"
    long = "x" * 300 + ".jpg"
    assert len(one(spark, (long,), lambda c: U.sanitize_filename(c, "plain"))) == 255
    assert len(one(spark, (long,), U.sanitize_filename)) == 204


def test_validation(spark):
    check = lambda value, kind, level="strict": one(spark, (value,), lambda c: V.validate(c, kind, level))
    assert check("https://example.com/gallery/page.html", "url")["valid"]
    assert not check("http://localhost/admin", "url")["valid"]
    assert not check("http://192.168.1.20/image.jpg", "url")["valid"]
    assert check("C:\\Users\\tester\\image.jpg", "file_path")["valid"]
    bad = check("downloads\\bad:name.jpg", "file_path")
    assert not bad["valid"] and V.ERRORS["path_chars"] in bad["errors"]
    assert not check("../../../etc/passwd", "file_path")["valid"]
    assert check("javascript:alert('xss')", "url")["errors"][0] == V.ERRORS["protocol"]
    assert check("x", "nothing")["errors"] == [V.ERRORS["unknown"] % "nothing"]
    assert check("a UNION  SELECT b", "user_input")["errors"] == [V.ERRORS["sql"]]
    assert check("http://8.8.8.8/a.jpg", "image_url", "paranoid")["errors"] == [V.ERRORS["ip"]]


def test_normal_forms_idempotent(spark):
    rows = [("https://H.x/A/?page=1&q=2#f",), ("http://a/b;c=1?tag=a+b&p=%20",), ("http://a//",)]
    for fn in (U.drop_fragment, U.keep_key_params):
        once = run(spark, rows, lambda c: fn(c))
        assert run(spark, [(u,) for u in once], lambda c: fn(c)) == once
