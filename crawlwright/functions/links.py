"""Predicates on sub-page links: which links of a page lead to more content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U

# Site sections, word lists and patterns that results depend on.
SECTIONS = ["Xiuren", "Xgyw", "LEGBABY", "HuaYang", "YouWu", "MissLeg", "Tuigirl", "MiStar", "Aiyouwu"]
SEED_SECTIONS = ["xiuren", "tuigirl", "legbaby", "huayang", "youwu", "xgyw", "missleg"]
AD_PATTERNS = [r"ad\.", r"banner\.", r"ads\.", r"analytics\.", r"tracking\.", r"click\.",
               r"redirect\.", r"promo\.", r"sponsor\.", r"affiliate\.", r"partner\."]
AD_PATHS = ["/ads/", "/ad/", "/banner/", "/sponsor/", "/affiliate/", "/analytics/", "/tracking/",
            "/click/", "/redirect/", "/promo/", "/partner/", "/external/", "/out/"]
GALLERY_PATH_PATTERNS = [r"/\w+\d+\.html$", r"/\w+\d+_\d+\.html$"]
CONTENT_PATH_PATTERNS = [r"/\w+\d+\.html$", r"/\w+\d+_\d+\.html$", r"/\w+\d+/$", r"/\w+\d+_\d+/$",
                         r"/pic/\d+/", r"/album/\d+/", r"/gallery/\d+/", r"/photos/\d+/"]
SEED_AD_DOMAINS = ["876512.xyz", "ad.", "ads.", "banner.", "promo.", "sponsor."]
EXCLUDED_LINK_TEXTS = ["login", "logout", "register", "signup", "signin", "登录", "注册", "退出", "登出",
                       "contact", "about", "privacy", "terms", "联系", "关于", "隐私", "条款",
                       "rss", "feed", "xml", "print", "打印", "share", "分享", "bookmark", "收藏"]
EXCLUDED_URL_PATTERN = r"(?i)#|javascript:|mailto:|tel:|\.(pdf|doc|docx|xls|xlsx|zip|rar)$"
PAGINATION_TEXT = r"next|下一页|more|继续|page\s*\d+|第\s*\d+\s*页|>\s*$|»|→"
PAGINATION_PARAMS = ["page", "p", "pagenum", "pageindex", "offset", "start"]
NEXT_WORDS = ["next", "下一页", "下一", "more"]
SIMPLE_SUBPAGE_PATTERN = r"(?i)/\d+\.html$|page-\d+|/\d+/?"
SERIES_MIN, SERIES_MAX = 2, 22
PRIORITIES = {"pagination": 10, "related": 7, "category": 5}


def _any(patterns: list[str]) -> str:
    return "|".join(patterns)


def is_gallery_path(low_path: Column, sections: list[str] = SECTIONS) -> Column:
    own = [f"^/{s.lower()}/{s.lower()}\\d+\\.html$" for s in sections]
    return low_path.rlike(_any(own + GALLERY_PATH_PATTERNS))


def _split(url, at: dict[str, Column] | None) -> tuple[Column, Column]:
    """Path and host of a url; from ``at`` where they were computed before."""
    return (at["path"], at["host"]) if at else (U.path(url), U.netloc(url))


def is_content_link(url, sections: list[str] = SECTIONS, at: dict[str, Column] | None = None) -> Column:
    """no advertisement, an html page, and a path that looks like content."""
    p, _ = _split(url, at)
    low = F.lower(p)
    name = U.stem(U.basename(p))
    looks = (name.rlike(r"^_?[0-9]+$") | low.rlike(_any([s.lower() for s in sections]))
             | low.rlike(_any(CONTENT_PATH_PATTERNS)))
    return F.when(U._c(url).rlike("(?i)" + _any(AD_PATTERNS)), is_gallery_path(low, sections)).otherwise(
        U.is_html_path(low) & ~low.rlike(_any(AD_PATHS)) & looks)


def is_container_link(url, base, sections: list[str] = SECTIONS, at: dict[str, Column] | None = None) -> Column:
    """F15 against a base split by ``url_parts``."""
    p, host = _split(url, at)
    digit = p.rlike(r"\d")
    exact = p.rlike(_any([f"^/{s}/{s}\\d+\\.html$" for s in sections]))
    numbered = U.is_numbered_stem(U.stem(U.basename(p)), U.stem(U.basename(base["path"])))
    keyword = F.lower(p).rlike(_any([s.lower() for s in sections])) & digit
    section_dir = (host == base["netloc"]) & p.rlike(_any([f"/{s}/" for s in sections])) & digit
    return U.is_html_path(p) & (exact | numbered | keyword | section_dir)


def is_neighbour_page(url, base, at: dict[str, Column] | None = None) -> Column:
    """F16: same host and html page; series number in range, or one directory inside the other."""
    p, host = _split(url, at)
    numbered = U.is_numbered_stem(U.stem(U.basename(p)), U.stem(U.basename(base["path"])))
    last = F.regexp_extract(p, r"(\d+)\D*$", 1).try_cast("bigint")
    a, b = U.dirname(p), U.dirname(base["path"])
    near = a.startswith(b) | b.startswith(a)
    return (host == base["netloc"]) & U.is_html_path(p) & F.when(
        numbered, F.coalesce(last.between(SERIES_MIN, SERIES_MAX), F.lit(False))).otherwise(near)


def is_includable(url, link_text) -> Column:
    """F17."""
    return ~(F.lower(F.coalesce(U._c(link_text), F.lit(""))).rlike(_any(EXCLUDED_LINK_TEXTS))
             | U._c(url).rlike(EXCLUDED_URL_PATTERN))


def is_simple_subpage(url, base_netloc: Column, pattern: str = SIMPLE_SUBPAGE_PATTERN) -> Column:
    """F18."""
    u = U._c(url)
    return u.rlike("^https?://") & (U.netloc(u) == base_netloc) & u.rlike(pattern)


def is_generation_seed(url, sections: list[str] = SEED_SECTIONS,
                       ad_domains: list[str] = SEED_AD_DOMAINS) -> Column:
    """html page outside ad hosts with a section word or a digit in its path."""
    low, loc = F.lower(U.path(url)), U.netloc(url)
    ad = F.lit(False)
    for d in ad_domains:
        ad = ad | loc.contains(d)
    return ~ad & U._ends(low, U.HTML_EXTS) & (low.rlike(_any(sections)) | low.rlike(r"\d"))


def is_pagination(link_text, title, href) -> Column:
    """H11's test: paging words in text or title, or a paging parameter with a value."""
    text = F.lower(F.concat(U._c(link_text), F.lit(" "), F.coalesce(U._c(title), F.lit(""))))
    keys = "|".join(PAGINATION_PARAMS)
    return text.rlike(PAGINATION_TEXT) | U.query(href).rlike(rf"(^|&)({keys})=[^&]")


def pagination_priority(link_text, title) -> Column:
    """U38 for paging links."""
    text = F.lower(F.concat(U._c(link_text), F.lit(" "), F.coalesce(U._c(title), F.lit(""))))
    return F.when(text.rlike(_any(NEXT_WORDS)), 10).when(text.rlike(r"\d"), 5).otherwise(3)


def type_priority(page_type) -> Column:
    """U38 by link type."""
    out = F
    for k, v in PRIORITIES.items():
        out = out.when(U._c(page_type) == k, v)
    return out.otherwise(1)


def is_domain_allowed(domain, allowed: list[str] = (), blocked: list[str] = ()) -> Column:
    """F19."""
    d = U._c(domain)
    ok = F.coalesce(d != "", F.lit(False))
    if blocked:
        ok = ok & ~d.isin(list(blocked))
    if allowed:
        ok = ok & d.isin(list(allowed))
    return F.coalesce(ok, F.lit(False))
