"""Url and file-name expressions.

Every function takes and returns Columns built from Spark's own functions, so
they stay inside whole-stage codegen and can be pushed into a scan projection.
A url is split leniently (a space or a bar in it is no error), which is why
the parts come from regular expressions and not from ``parse_url``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and limits that results depend on.
IMAGE_EXTS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "ico"]
CONTENT_IMAGE_EXTS = ["jpg", "jpeg", "png", "webp", "gif"]
SUPPORTED_FORMATS = ["jpg", "jpeg", "png", "gif", "webp", "bmp"]
HASH_NAME_EXTS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp"]
CRAWLABLE_PAGE_EXTS = ["html", "htm", "php", "asp", "aspx"]
HTML_EXTS = ["html", "htm", "php", "asp", "aspx", "jsp"]
VALIDATED_IMAGE_EXTS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "svg"]
KEY_PARAMS = ["page", "p", "id", "category", "tag"]
IMAGE_URL_PATTERN = (
    r"(?i)\.(jpg|jpeg|png|gif|webp|bmp|svg|ico)(\?[^?\s]*)?$"
    r"|/images?/|/img/|/photos?/|/pics?/|/gallery/|/media/"
)
SIZE_PATTERNS = [r"(?i)(\d+)x(\d+)", r"(\d+)_(\d+)", r"(?i)w(\d+)h(\d+)", r"(?i)(\d+)w(\d+)h"]
SIZE_HINT_MIN, SIZE_HINT_MAX = 10, 10000
MIME_EXTS = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif",
    "image/webp": "webp", "image/bmp": "bmp", "image/svg+xml": "svg", "image/x-icon": "ico",
}
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL",
                  *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
UNSAFE_NAME_CHARS = r'[<>:"/\\|?*]'
NUMBERED_SECTIONS = ["Xiuren", "Xgyw", "LEGBABY"]
STATUS_LABELS = {
    "waiting": "⏳ 等待中", "downloading": "⬇️ 下载中", "completed": "✅ 已完成",
    "failed": "❌ 失败", "cancelled": "🚫 已取消",
}
STATUS_LABEL_DEFAULT = "❓ 未知"
SIZE_UNKNOWN = "未知"

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_PREFIX = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and named, which keeps deep expressions small."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text) -> Column:
    """Trim all white space, not only blanks."""
    return F.trim(_c(text), F.lit(" \t\n\r\f\x0b"))


def _ends(path: Column, exts: list[str]) -> Column:
    return path.rlike(r"\.(" + "|".join(exts) + r")$")


# ---------------------------------------------------------------- url parts

def tidy(url) -> Column:
    """Drop tabs and line breaks anywhere and control characters in front."""
    return F.regexp_replace(_c(url), r"^[\x00-\x20]+|[\t\r\n]", "")


def _scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def _netloc(u: Column) -> Column:
    return F.regexp_extract(u, _PREFIX + r"//([^/?#]*)", 1)


def _raw_path(u: Column) -> Column:
    return F.regexp_extract(u, _PREFIX + r"(?://[^/?#]*)?([^?#]*)", 1)


def _path(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^((?:.*/)?[^/;]*)", 1)


def _params(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^(?:.*/)?[^/;]*;(.*)$", 1)


def _query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def _fragment(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^#]*#(.*)$", 1)


def scheme(url) -> Column:
    return _scheme(tidy(url))


def netloc(url) -> Column:
    """U4: host with port and user info, original case."""
    return _netloc(tidy(url))


def path(url) -> Column:
    """Path without the ``;params`` of its last segment."""
    return _path(_raw_path(tidy(url)))


def params(url) -> Column:
    return _params(_raw_path(tidy(url)))


def query(url) -> Column:
    return _query(tidy(url))


def fragment(url) -> Column:
    return _fragment(tidy(url))


def basename(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)$", 1)


def dirname(p: Column) -> Column:
    """Directory of a path; no trailing slash unless the directory is the root."""
    head = F.regexp_extract(p, r"^(.*/)", 1)
    return F.when(head.rlike("^/+$"), head).otherwise(F.regexp_replace(head, "/+$", ""))


def stem(name: Column) -> Column:
    """File name without its last extension; leading dots are no extension."""
    return F.regexp_replace(name, r"^(\.*[^.].*?)\.[^.]*$", "$1")


URL_PARTS = ("scheme", "netloc", "path", "params", "query", "fragment")


def url_parts(url) -> Column:
    """The split url as one struct column."""
    return let(tidy(url), lambda u: F.struct(
        _scheme(u).alias("scheme"), _netloc(u).alias("netloc"), _path(_raw_path(u)).alias("path"),
        _params(_raw_path(u)).alias("params"), _query(u).alias("query"), _fragment(u).alias("fragment")))


# --------------------------------------------------------------- predicates

def is_absolute(url) -> Column:
    """Scheme and host are both there."""
    return F.coalesce((scheme(url) != "") & (netloc(url) != ""), F.lit(False))


def has_url_prefix(url) -> Column:
    """After trimming, starts with http://, https://, // or /."""
    return F.coalesce(strip(url).rlike(r"^(https?://|/)"), F.lit(False))


def is_crawlable(url) -> Column:
    """U3."""
    p = F.lower(path(url))
    ok = (_ends(p, CONTENT_IMAGE_EXTS) | _ends(p, CRAWLABLE_PAGE_EXTS)
          | ~basename(p).contains(".") | p.endswith("/"))
    return is_absolute(url) & F.coalesce(ok, F.lit(False))


def same_domain(a, b, ignore_case: bool = False) -> Column:
    """Equal hosts, exact or ignoring case."""
    x, y = netloc(a), netloc(b)
    return (F.lower(x) == F.lower(y)) if ignore_case else (x == y)


def is_html_path(p: Column) -> Column:
    low = F.lower(p)
    return _ends(low, HTML_EXTS) | ~basename(low).contains(".") | low.endswith("/")


def is_html_page(url) -> Column:
    """U27."""
    return is_html_path(path(url))


def is_numbered_stem(target: Column, base: Column) -> Column:
    """U28 on file stems: base + optional underscore + digits."""
    tail = F.substr(target, F.length(base) + 1)
    return target.startswith(base) & tail.rlike(r"^_?[0-9]+$")


def is_numbered_page(url, base_url) -> Column:
    """U28."""
    return is_numbered_stem(stem(basename(path(url))), stem(basename(path(base_url))))


def is_current_page(url, base_url) -> Column:
    """U26."""
    return keep_key_params(url) == keep_key_params(base_url)


def is_image_url(url, variant: str = "content") -> Column:
    """``content``, ``rich``, ``simple`` or ``validated`` image test."""
    if variant == "content":
        p, low = F.lower(path(url)), F.lower(_c(url))
        hit = (_ends(p, CONTENT_IMAGE_EXTS) | low.rlike("|".join(CONTENT_IMAGE_EXTS))
               | ~basename(p).contains("."))
        return is_absolute(url) & F.coalesce(hit, F.lit(False))
    if variant == "rich":
        hit = file_extension(url).isin(SUPPORTED_FORMATS) | _c(url).rlike(IMAGE_URL_PATTERN)
        return has_url_prefix(url) & F.coalesce(hit, F.lit(False))
    p = F.lower(path(url))
    if variant == "simple":
        return F.coalesce(_ends(p, SUPPORTED_FORMATS) | p.rlike("/images/|/img/|/photo/"), F.lit(False))
    if variant == "validated":
        return F.coalesce(_ends(p, VALIDATED_IMAGE_EXTS), F.lit(False))
    raise ValueError(f"unknown variant: {variant}")


# ------------------------------------------------------------- normal forms

def drop_fragment(url) -> Column:
    """Scheme, host, path and query only."""
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), netloc(url), path(url),
                    F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def decode_component(text: Column) -> Column:
    """Form decoding: '+' is a space; malformed escapes stay as they are."""
    return F.when(text.rlike("[%+]"), F.coalesce(F.try_url_decode(text), text)).otherwise(text)


def decode_path(text: Column) -> Column:
    """Percent decoding where '+' stays '+'."""
    return F.when(text.contains("%"),
                  F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
                  ).otherwise(text)


def encode_form(text: Column) -> Column:
    """Form encoding with the safe set of query strings: '~' is safe, '*' is not."""
    enc = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(enc, F.lit("%7E"), F.lit("~"))


def query_pairs(q: Column, keep_blank: bool) -> Column:
    """Array of decoded ``struct<k,v>`` in order; pairs without '=' only if blanks stay."""
    def pair(x):
        return F.struct(decode_component(F.regexp_extract(x, r"^([^=]*)", 1)).alias("k"),
                        decode_component(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)).alias("v"))
    def wanted(x):
        return (x != "") if keep_blank else x.rlike(r"^[^=]*=.")
    return F.transform(F.filter(F.split(q, "&"), wanted), pair)


def keep_key_params(url, keys: list[str] = KEY_PARAMS) -> Column:
    """Only the key parameters, first value of each, original order."""
    base = F.concat(scheme(url), F.lit("://"), netloc(url), path(url))
    q = query(url)
    pairs = F.filter(query_pairs(q, False), lambda p: F.lower(p["k"]).isin(keys))
    first = F.aggregate(
        pairs, F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc)
        .otherwise(F.concat(acc, F.array(p))))
    text = F.array_join(F.transform(
        first, lambda p: F.concat(encode_form(p["k"]), F.lit("="), encode_form(p["v"]))), "&")
    return F.when(q == "", base).otherwise(
        F.regexp_replace(F.concat(base, F.lit("?"), text), r"\?$", ""))


def fold_url(url) -> Column:
    """No query or fragment, one trailing slash less, lower case."""
    base = F.concat(scheme(url), F.lit("://"), netloc(url), path(url))
    return F.lower(F.regexp_replace(base, "/$", ""))


def preprocess(url) -> Column:
    """U8: default scheme, parameters de-duplicated with the last value at the first place."""
    u = strip(url)
    u = F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("http://"), u))
    q, f, p, pr = query(u), fragment(u), path(u), params(u)
    merged = F.aggregate(
        query_pairs(q, True), F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda a: a["k"] == x["k"]),
            F.transform(acc, lambda a: F.when(a["k"] == x["k"], x).otherwise(a)))
        .otherwise(F.concat(acc, F.array(x))))
    text = F.array_join(F.transform(
        merged, lambda a: F.concat(encode_form(a["k"]), F.lit("="), encode_form(a["v"]))), "&")
    return F.concat(
        scheme(u), F.lit("://"), netloc(u), p,
        F.when(pr != "", F.concat(F.lit(";"), pr)).otherwise(""),
        F.when(q == "", "").otherwise(F.regexp_replace(F.concat(F.lit("?"), text), r"^\?$", "")),
        F.when(f != "", F.concat(F.lit("#"), f)).otherwise(""))


def remove_dots(p: Column) -> Column:
    """Resolve '.' and '..' segments of a path."""
    folded = F.aggregate(
        F.split(F.regexp_replace(p, r"(^|/)(\.\.?)$", "$1$2/"), "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(folded, "/")).otherwise(p)


def _unsplit(sch: Column, loc: Column, p: Column, par: Column, q: Column, f: Column) -> Column:
    def lead(mark: str, part: Column) -> Column:
        return F.when(part != "", F.concat(F.lit(mark), part)).otherwise("")
    slash = F.when((loc != "") & (p != "") & ~p.startswith("/"), "/").otherwise("")
    return F.concat(sch, F.lit("://"), loc, slash, p, lead(";", par), lead("?", q), lead("#", f))


def _resolve(b: Column, r: Column) -> Column:
    """Reference parts ``r`` without scheme or host, against base parts ``b``."""
    folder = F.regexp_extract(b["path"], r"^(.*/)", 1)
    rel = F.concat(F.when(folder == "", "/").otherwise(folder), r["path"])
    rel = F.concat(F.substr(rel, F.lit(1), F.lit(1)), F.regexp_replace(F.substr(rel, F.lit(2)), "(?<=/)/+|^/+", ""))
    full = remove_dots(F.when(r["path"].startswith("/"), r["path"]).otherwise(rel))
    full = F.when(full == "", "/").otherwise(full)
    own = (r["path"] != "") | (r["params"] != "")
    return F.when(own, _unsplit(b["scheme"], b["netloc"], full, r["params"], r["query"], r["fragment"])).otherwise(
        _unsplit(b["scheme"], b["netloc"], b["path"], b["params"],
                 F.when(r["query"] != "", r["query"]).otherwise(b["query"]), r["fragment"]))


def join_parts(base: Column, ref) -> Column:
    """U9 against a base already split by :func:`url_parts`."""
    text, b = _c(ref), base
    whole = _unsplit(b["scheme"], b["netloc"], b["path"], b["params"], b["query"], b["fragment"])
    return F.when(text == "", whole).otherwise(let(url_parts(text), lambda r: (
        F.when((r["scheme"] != "") & (r["scheme"] != b["scheme"]), text)
        .when(r["netloc"] != "", _unsplit(b["scheme"], r["netloc"], r["path"], r["params"], r["query"], r["fragment"]))
        .otherwise(_resolve(b, r)))))


def join_url(base_url, ref) -> Column:
    """Resolve a reference against a page url."""
    return join_parts(url_parts(base_url), ref)


def clean_url(url) -> Column:
    """Trimmed, scheme-relative becomes https."""
    u = strip(F.coalesce(_c(url), F.lit("")))
    return F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)


def reencode(url) -> Column:
    """Percent-quote path, query and fragment; what is encoded already is encoded again."""
    def quote(text: Column, safe: dict[str, str], plus: bool) -> Column:
        enc = encode_form(text)
        if not plus:
            enc = F.replace(enc, F.lit("+"), F.lit("%20"))
        for escaped, char in safe.items():
            enc = F.replace(enc, F.lit(escaped), F.lit(char))
        return enc
    pr, q, f = params(url), query(url), fragment(url)
    return F.concat(
        scheme(url), F.lit("://"), netloc(url), quote(path(url), {"%2F": "/"}, False),
        F.when(pr != "", F.concat(F.lit(";"), pr)).otherwise(""),
        F.when(q != "", F.concat(F.lit("?"), quote(q, {"%26": "&", "%3D": "="}, True))).otherwise(""),
        F.when(f != "", F.concat(F.lit("#"), quote(f, {}, False))).otherwise(""))


# --------------------------------------------------------------- file names

def _cap_stem(name: Column, limit: int) -> Column:
    st = stem(name)
    return F.concat(F.substr(st, F.lit(1), F.lit(limit)), F.substr(name, F.length(st) + 1))


def sanitize_filename(name, variant: str = "download") -> Column:
    """``download``, ``validated`` or ``plain`` file-name clean-up."""
    n = F.regexp_replace(_c(name), UNSAFE_NAME_CHARS, "_")
    if variant == "download":
        n = F.regexp_replace(n, r"[\x00-\x1f\x7f-\x9f]", "")
        return let(n, lambda x: let(_cap_stem(x, 200), lambda c: strip(
            F.when(F.upper(stem(c)).isin(RESERVED_NAMES), F.concat(F.lit("_"), c)).otherwise(c))))
    if variant == "validated":
        n = F.regexp_replace(n, r"[\x00-\x1f]", "")
        st = stem(n)
        ext = F.substr(n, F.length(st) + 1)
        capped = F.concat(F.substr(st, F.lit(1), F.lit(255) - F.length(ext)), ext)
        n = F.when(F.length(n) > 255, capped).otherwise(n)
        head = F.regexp_extract(F.upper(n), r"^([^.]*)", 1)
        return F.when(head.isin(RESERVED_NAMES), F.concat(F.lit("_"), n)).otherwise(n)
    if variant == "plain":
        ext = F.regexp_extract(n, r"\.([^.]*)$", 1)
        st = F.regexp_replace(n, r"\.[^.]*$", "")
        room = F.when(ext != "", F.lit(254) - F.length(ext)).otherwise(F.lit(255))
        capped = F.concat(F.substr(st, F.lit(1), room),
                          F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
        return F.when(F.length(n) > 255, capped).otherwise(n)
    raise ValueError(f"unknown variant: {variant}")


def filename_from_url(url) -> Column:
    """File name of a url, or null when nothing with a dot is found."""
    name = F.regexp_extract(decode_path(path(url)), r"([^/]*)$", 1)
    param = decode_path(F.regexp_extract(query(url), r"(?i)(?:file|filename|name)=([^&]+)", 1))
    name = let(F.struct(name.alias("own"), param.alias("param")), lambda n: F.when(
        n["own"].contains("."), n["own"]).when(n["param"].contains("."), n["param"]).otherwise(n["own"]))
    return let(sanitize_filename(name), lambda clean: F.when(clean.contains("."), clean))


def file_extension(url) -> Column:
    """U18."""
    bare = F.regexp_extract(_c(url), r"^([^?#]*)", 1)
    ext = F.lower(F.regexp_extract(bare, r"\.([^.]*)$", 1))
    return F.when(ext.isin(IMAGE_EXTS), ext).otherwise("")


def directory_name(url) -> Column:
    """Archive directory; the last match longer than 3 of each pattern in turn."""
    p, loc = path(url), netloc(url)

    def last(pattern: str) -> Column:
        hit = F.try_element_at(F.regexp_extract_all(p, F.lit(pattern), F.lit(1)), F.lit(-1))
        return F.when(F.length(hit) > 3, sanitize_filename(hit))
    host = F.regexp_replace(F.regexp_replace(loc, r"^www\.", ""), r"\.[^.]+$", "")
    return F.coalesce(
        last(r"([A-Za-z]+\d+)"), last(r"(\w+?)(?:_\d+)?(?:\.\w+)?$"), last(r"/([^/]+?)(?:/[^/]*)?$"),
        F.when(loc != "", sanitize_filename(host)),
        F.concat(F.lit("task_"), F.substr(F.md5(_c(url)), F.lit(1), F.lit(8))))


def task_directory(url, name=None) -> Column:
    """Given name, else stem of the last path segment, else host and hash."""
    last = F.regexp_extract(F.regexp_replace(path(url), "^/+|/+$", ""), r"([^/]*)$", 1)
    st = stem(last)
    fallback = F.concat(netloc(url), F.lit("_"), F.substr(F.md5(_c(url)), F.lit(1), F.lit(8)))
    own = F.when(st != "", sanitize_filename(st)).otherwise(fallback)
    if name is None:
        return own
    given = _c(name)
    return F.when(given != "", sanitize_filename(given)).otherwise(own)


def hashed_image_name(url) -> Column:
    """U21."""
    low = F.lower(_c(url))
    ext = F.coalesce(*[F.when(low.contains(e), F.lit(e)) for e in HASH_NAME_EXTS], F.lit(".jpg"))
    return F.concat(F.lit("image_"), F.substr(F.md5(_c(url)), F.lit(1), F.lit(8)), ext)


def image_target_name(url, filename=None) -> Column:
    """File name a download is stored under: given, from the url, or hashed."""
    names = [F.nullif(_c(filename), F.lit(""))] if filename is not None else []
    return sanitize_filename(F.coalesce(*names, filename_from_url(url), hashed_image_name(url)))


# ------------------------------------------------- numbers and neighbourhood

def url_numbers(url) -> Column:
    """All digit runs, in order."""
    return F.regexp_extract_all(_c(url), F.lit(r"(\d+)"), F.lit(1))


def neighbour_urls(url, first: int, last: int) -> Column:
    """The last number's text, at its first occurrence, runs from first to last."""
    u = _c(url)
    num = F.try_element_at(url_numbers(u), F.lit(-1))
    at = F.instr(u, num)
    made = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: F.concat(
        F.substr(u, F.lit(1), at - 1), i.cast("string"), F.substr(u, at + F.length(num))))
    return F.when(num.isNull(), F.array(u)).otherwise(made)


def sibling_urls(url, count: int = 20, sections: list[str] = NUMBERED_SECTIONS) -> Column:
    """Numbered siblings of a page, by section pattern or by the first number."""
    p = path(url)
    site = F.concat(scheme(url), F.lit("://"), netloc(url))

    def pages_of(prefix: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(count)),
                           lambda i: F.concat(prefix, i.cast("string"), F.lit(".html")))
    out = F
    for s in sections:
        base = F.regexp_extract(p, f"/{s}/({s}\\d+)", 1)
        out = out.when(base != "", pages_of(F.concat(site, F.lit(f"/{s}/"), base, F.lit("_"))))
    n = F.regexp_extract(p, r"(\d+)", 1).try_cast("bigint")
    flat = F.regexp_replace(p, r"\d+", n.cast("string"))
    generic = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.concat(
        site, F.replace(flat, n.cast("string"), (n + i).cast("string"))))
    out = out.when(n.isNotNull(), generic)
    return out.otherwise(F.array().cast("array<string>"))


_RANGE = r"\{(\d+)-(\d+)\}"


def pattern_ranges(pattern) -> Column:
    """U16: ``array<struct<low,high,before>>`` of a pattern's ranges ``{low-high}``; ``before`` urls come before a range's own.

    Ranges that run backwards or beyond 64 bits hold no numbers.
    """
    p = _c(pattern)
    ends = F.filter(F.zip_with(
        F.regexp_extract_all(p, F.lit(_RANGE), F.lit(1)), F.regexp_extract_all(p, F.lit(_RANGE), F.lit(2)),
        lambda a, b: F.struct(a.try_cast("bigint").alias("low"), b.try_cast("bigint").alias("high"))), lambda r: r.low <= r.high)
    return F.transform(ends, lambda r, i: F.struct(r.low.alias("low"), r.high.alias("high"), F.aggregate(
        F.slice(ends, 1, i), F.lit(0).cast("bigint"), lambda n, x: n + (x.high - x.low + 1)).alias("before")))


def numbered_url(pattern, number) -> Column:
    """U16: a pattern with ``number`` in the place of its first range."""
    p = _c(pattern)
    return F.concat(F.regexp_extract(p, r"^(.*?)\{\d+-\d+\}", 1), _c(number).cast("string"),
                    F.regexp_extract(p, r"^.*?\{\d+-\d+\}(.*)$", 1))


def pattern_choices(base_url, pattern) -> Column:
    """U16: array of urls a pattern without ranges stands for; null for one with ranges."""
    p, base = _c(pattern), _c(base_url)
    group = F.regexp_extract(p, r"(\{[^}]+\})", 1)
    items = F.transform(F.split(F.regexp_replace(group, r"^\{|\}$", ""), ","), strip)
    listed = F.transform(items, lambda x: F.replace(p, group, x))
    num = F.try_element_at(url_numbers(base), F.lit(-1))
    n = num.cast("bigint")
    glob = F.concat(F.lit("(?s)^"), F.replace(F.replace(F.regexp_replace(
        p, r"([\\.+^$(){}|\[\]])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    stars = F.filter(F.transform(
        F.sequence(F.greatest(n - 5, F.lit(1).cast("bigint")), n + 5),
        lambda i: F.replace(base, num, i.cast("string"))), lambda u: F.rlike(u, glob))
    return (F.when(F.rlike(p, F.lit(_RANGE)), F.lit(None).cast("array<string>"))
            .when(group != "", listed)
            .when(p.contains("*") & num.isNotNull() & (F.size(stars) > 0), stars)
            .otherwise(F.array(p)))


def size_hint(url) -> Column:
    """``struct<width,height>`` read from the url, or null."""
    u = _c(url)
    def pair(pattern: str) -> Column:
        read = F.struct(F.regexp_extract(u, pattern, 1).try_cast("bigint").alias("width"),
                        F.regexp_extract(u, pattern, 2).try_cast("bigint").alias("height"))
        inside = lambda v: v.between(SIZE_HINT_MIN, SIZE_HINT_MAX)
        return let(read, lambda s: F.when(inside(s["width"]) & inside(s["height"]), s))
    return F.coalesce(*[pair(p) for p in SIZE_PATTERNS])


def parse_dimension(value) -> Column:
    """Pixels as an int; blank or unreadable is 0."""
    num = F.trim(F.replace(F.lower(_c(value).cast("string")), F.lit("px"), F.lit(""))).try_cast("double")
    return F.coalesce(num.try_cast("int"), F.lit(0))


def mime_extension(content_type) -> Column:
    """U32."""
    low = F.lower(_c(content_type))
    return F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in MIME_EXTS.items()], F.lit(""))


def charset_of(content_type) -> Column:
    """U33."""
    return F.trim(F.regexp_extract(F.lower(F.coalesce(_c(content_type), F.lit(""))), r"charset=([^;]*?)(?:;|charset=|$)", 1))


# ---------------------------------------------------- similarity and labels

def edit_distance(a, b) -> Column:
    """U23."""
    return F.levenshtein(_c(a), _c(b))


def bare_path(url) -> Column:
    return F.regexp_replace(path(url), "^/+|/+$", "")


def path_similarity(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.5)).otherwise(
        (longer - F.levenshtein(a, b)).cast("double") / longer)


def url_similarity(a, b) -> Column:
    """U24."""
    return F.when(netloc(a) != netloc(b), F.lit(0.0)).otherwise(path_similarity(bare_path(a), bare_path(b)))


def human_size(size) -> Column:
    """B to PB in steps of 1024; unknown when not positive."""
    s = _c(size).cast("double")
    out = F.when(F.coalesce(s, F.lit(0.0)) <= 0, F.lit(SIZE_UNKNOWN)).when(
        s < 1024, F.concat(s.cast("bigint").cast("string"), F.lit(" B")))
    for i, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = out.when(s < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", F.bround(s / (1024.0 ** i), 1)))
    return out.otherwise(F.format_string("%.1f PB", F.bround(s / 1024.0 ** 5, 1)))


def human_duration(seconds) -> Column:
    s = _c(seconds).cast("double")
    return (F.when(s < 0, "--").when(s < 60, F.format_string("%s秒", F.bround(s, 0).cast("bigint")))
            .when(s < 3600, F.format_string("%s分钟", F.bround(s / 60, 0).cast("bigint")))
            .otherwise(F.format_string("%.1f小时", F.bround(s / 3600, 1))))


def clock(seconds) -> Column:
    s = F.floor(_c(seconds)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def human_speed(speed) -> Column:
    s = _c(speed).cast("double")
    return (F.when(s < 1024, F.format_string("%s B/s", F.bround(s, 0).cast("bigint")))
            .when(s < 1024 * 1024, F.format_string("%.1f KB/s", F.bround(s / 1024, 1)))
            .otherwise(F.format_string("%.1f MB/s", F.bround(s / (1024 * 1024), 1))))


def status_label(status) -> Column:
    s = _c(status)
    return F.coalesce(*[F.when(s == k, F.lit(v)) for k, v in STATUS_LABELS.items()], F.lit(STATUS_LABEL_DEFAULT))
