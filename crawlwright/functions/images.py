"""Image rules as Columns: size, name, format, keyword, host and quality.

Rules that explain themselves return a reason text, or null when the image
passes. Images are rows with ``url, filename, alt_text, title, css_class,
element_id, width, height, file_size, content_type``; null means unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U

# Rule defaults, word lists and patterns that results depend on.
DEFAULT_RULES = {
    "min_width": 100, "min_height": 100, "max_width": 10000, "max_height": 10000,
    "min_file_size": 1024, "max_file_size": 50 * 1024 * 1024,
    "allowed_formats": ["jpg", "jpeg", "png", "gif", "webp", "bmp"],
    "blocked_domains": [],
    "blocked_keywords": ["avatar", "icon", "logo", "banner", "ad", "advertisement"],
    "required_keywords": [], "min_quality_score": 0.5,
}
DECORATIVE_WORDS = ["logo", "icon", "btn", "button", "nav", "menu", "ad", "banner"]
LARGE_PATTERNS = [r"/uploadfile/\d{4,6}/\d{1,4}/", r"\.webp$", r"\.jpg$", r"\.jpeg$", r"\.png$",
                  "large", "big", "original", "full"]
SMALL_PATTERNS = [r"\.gif$", "thumb", "small", "icon", "logo", "btn", "button", "nav", "menu",
                  "banner", r"_s\.", r"_m\.", r"_t\.", r"mm\d+\."]
AD_WORD = "ad"
CONTENT_MIN_WIDTH, CONTENT_MIN_HEIGHT = 800, 600
QUALITY_NAME_WORDS = ["high", "hd", "large", "big"]
QUALITY_URL_WORDS = ["original", "full", "large", "high"]
SKIPPED_PATHS = ["/uploadfile/pic/", "/pic/uploadfile/"]
PREFILTER_DEFAULTS = {"min_size": 51200, "max_size": 10485760, "min_width": 800, "min_height": 600,
                      "enable_size_filter": True, "enable_resolution_filter": True,
                      "resolution_check_mode": "smart"}
REASON = {
    "narrow": "宽度过小: %s < %s", "short": "高度过小: %s < %s",
    "wide": "宽度过大: %s > %s", "tall": "高度过大: %s > %s",
    "light": "文件过小: %s < %s", "heavy": "文件过大: %s > %s",
    "format": "不支持的格式: %s", "blocked": "包含阻止的关键词: %s", "required": "缺少必需的关键词: %s",
    "domain": "来自阻止的域名: %s", "quality": "质量评分过低: %.2f < %s",
    "bad_url": "无效的URL", "long_url": "URL过长", "data_url": "数据URL",
}
MAX_URL_LENGTH = 2000


def merge_rules(options: dict | None = None, config: dict | None = None) -> dict:
    """defaults, overlaid by config values that are set, overlaid by options."""
    return {**DEFAULT_RULES, **{k: v for k, v in (config or {}).items() if v is not None}, **(options or {})}


def is_large(url) -> Column:
    """true unless the url says it is a thumbnail; '/pic/' only with a numeric name."""
    u = F.lower(U._c(url))
    small = "|".join(SMALL_PATTERNS)
    return (F.when(u.contains("/pic/"), u.rlike(r"/pic/\d+\.(jpg|jpeg|png|webp)$"))
            .when(u.contains("/uploadfile/") & (u.endswith(".webp") | ~u.rlike(small)), True)
            .when(u.rlike("|".join(LARGE_PATTERNS)), ~u.rlike(f"{small}|{AD_WORD}"))
            .otherwise(True))


def has_plain_name(filename, words: list[str] = DECORATIVE_WORDS) -> Column:
    """no decorative word in the file name ('ad' also hits inside words)."""
    return ~F.lower(F.coalesce(U._c(filename), F.lit(""))).rlike("|".join(words))


def has_content_size(width, height, min_width: int = CONTENT_MIN_WIDTH,
                     min_height: int = CONTENT_MIN_HEIGHT) -> Column:
    """only a fully declared, too small size is rejected."""
    w, h = F.nullif(U._c(width), F.lit(0)), F.nullif(U._c(height), F.lit(0))
    small = (w < min_width) | (h < min_height)
    return ~F.coalesce(w.isNotNull() & h.isNotNull() & small, F.lit(False))


def passes_three_levels(url, filename, width, height) -> Column:
    """F1."""
    return has_plain_name(filename) & is_large(url) & has_content_size(width, height)


def skipped_by_path(url) -> Column:
    """F21."""
    return F.lower(U.path(url)).rlike("|".join(SKIPPED_PATHS))


def known_size(url, width, height) -> Column:
    """Declared size, replaced by the url's size hint when either side is unknown."""
    w = F.coalesce(U._c(width).cast("bigint"), F.lit(0).cast("bigint"))
    h = F.coalesce(U._c(height).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when((w != 0) & (h != 0), F.struct(w.alias("width"), h.alias("height"))).otherwise(
        F.coalesce(U.size_hint(url), F.struct(w.alias("width"), h.alias("height"))))


def size_reason(width, height, rules: dict = DEFAULT_RULES) -> Column:
    """F5 on a known size; 0 is unknown."""
    w, h = F.nullif(U._c(width), F.lit(0)), F.nullif(U._c(height), F.lit(0))
    text = lambda key, v, lim: F.format_string(REASON[key], v.cast("string"), F.lit(str(lim)))
    return (F.when(w < rules["min_width"], text("narrow", w, rules["min_width"]))
            .when(h < rules["min_height"], text("short", h, rules["min_height"]))
            .when(w > rules["max_width"], text("wide", w, rules["max_width"]))
            .when(h > rules["max_height"], text("tall", h, rules["max_height"])))


def dimension_reason(url, width, height, rules: dict = DEFAULT_RULES) -> Column:
    """F5."""
    return U.let(known_size(url, width, height), lambda s: size_reason(s["width"], s["height"], rules))


def file_size_reason(file_size, rules: dict = DEFAULT_RULES) -> Column:
    """F6."""
    s = F.nullif(U._c(file_size), F.lit(0))
    text = lambda key, lim: F.format_string(REASON[key], s.cast("string"), F.lit(str(lim)))
    return (F.when(s < rules["min_file_size"], text("light", rules["min_file_size"]))
            .when(s > rules["max_file_size"], text("heavy", rules["max_file_size"])))


def format_reason(url, content_type, rules: dict = DEFAULT_RULES) -> Column:
    """F7."""
    allowed = [f.lower() for f in rules["allowed_formats"]]
    if not allowed:
        return F.lit(None).cast("string")
    own = U.file_extension(url)
    ext = F.when(own != "", own).otherwise(U.mime_extension(F.coalesce(U._c(content_type), F.lit(""))))
    return F.when((ext != "") & ~ext.isin(allowed), F.format_string(REASON["format"], ext))


def image_text(url, filename, alt_text, title, css_class, element_id) -> Column:
    parts = [F.coalesce(U._c(c).cast("string"), F.lit("")) for c in
             (url, filename, alt_text, title, css_class, element_id)]
    return F.lower(F.concat_ws(" ", *parts))


def keyword_reason(text: Column, rules: dict = DEFAULT_RULES) -> Column:
    """F8: the first blocked word decides; else a missing required word."""
    out = F
    for k in rules["blocked_keywords"]:
        out = out.when(text.contains(k.lower()), F.lit(REASON["blocked"] % k))
    required = rules["required_keywords"]
    if required:
        missing = ~F.exists(F.array(*[F.lit(k.lower()) for k in required]), lambda k: text.contains(k))
        out = out.when(missing, F.lit(REASON["required"] % required))
    return F.lit(None).cast("string") if out is F else out.otherwise(F.lit(None).cast("string"))


def domain_reason(url, rules: dict = DEFAULT_RULES) -> Column:
    """F9."""
    loc = F.lower(U.netloc(url))
    out = F
    for d in rules["blocked_domains"]:
        out = out.when(loc.contains(d.lower()), F.lit(REASON["domain"] % d))
    return F.lit(None).cast("string") if out is F else out.otherwise(F.lit(None).cast("string"))


def quality_score(url, filename, alt_text, width, height) -> Column:
    """0.5 plus steps for resolution, shape, name, alt text and url words."""
    w = F.nullif(U._c(width).cast("bigint"), F.lit(0).cast("bigint"))
    h = F.nullif(U._c(height).cast("bigint"), F.lit(0).cast("bigint"))
    ratio = w.cast("double") / h
    low = F.lower(U._c(url))
    step = lambda cond: F.when(cond, 0.1).otherwise(0.0)
    # added in this order as doubles: 0.7 + 0.1 stays just below 0.8
    score = (F.lit(0.5)
             + F.when(w * h >= 1920 * 1080, 0.2).when(w * h >= 1280 * 720, 0.1).otherwise(0.0)
             + step(ratio.between(0.5, 2.0))
             + step(F.lower(U._c(filename)).rlike("|".join(QUALITY_NAME_WORDS)))
             + step(F.length(U.strip(alt_text)) > 5)
             + step(low.rlike("|".join(QUALITY_URL_WORDS))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def quality_reason(score: Column, rules: dict = DEFAULT_RULES) -> Column:
    """F10."""
    least = rules["min_quality_score"]
    if least <= 0:
        return F.lit(None).cast("string")
    return F.when(score < least, F.format_string(REASON["quality"], score, F.lit(str(least))))


def url_reason(url) -> Column:
    """F11."""
    u = U._c(url)
    return (F.when(u.isNull() | ~U.has_url_prefix(u), REASON["bad_url"])
            .when(F.length(u) > MAX_URL_LENGTH, REASON["long_url"])
            .when(u.startswith("data:"), REASON["data_url"]))


def is_supported_format(name, formats: list[str] = U.SUPPORTED_FORMATS) -> Column:
    """format membership, leading dots ignored."""
    return F.coalesce(F.ltrim(F.lower(U._c(name)), F.lit(".")).isin(formats), F.lit(False))


def is_valid_dimensions(width, height, rules: dict = DEFAULT_RULES) -> Column:
    """both sides inside the configured range."""
    return (U._c(width).between(rules["min_width"], rules["max_width"])
            & U._c(height).between(rules["min_height"], rules["max_height"]))


def is_complete_file(size, expected=None) -> Column:
    """Not empty, and of the expected size when one is known."""
    ok = U._c(size) > 0
    if expected is not None:
        ok = ok & F.coalesce(U._c(size) == U._c(expected), F.lit(True))
    return ok


def is_reasonable_file(size, low: int = 100, high: int = 50 * 1024 * 1024) -> Column:
    """Between 100 bytes and 50 MiB."""
    return U._c(size).between(low, high)


def is_valid_file_size(size, low: int = 1024, high: int = 10 * 1024 * 1024) -> Column:
    """Inside the configured range."""
    return U._c(size).between(low, high)


def prefilter_reason(file_size, width, height, options: dict | None = None) -> Column:
    """reason to drop an image before download; unknown values pass."""
    o = {**PREFILTER_DEFAULTS, **(options or {})}
    size, w, h = U._c(file_size), U._c(width), U._c(height)
    out = F
    if o["enable_size_filter"]:
        out = out.when(size < o["min_size"], "size").when(size > o["max_size"], "size")
    if o["enable_resolution_filter"] and o["resolution_check_mode"] in ("smart", "always"):
        low = (w < o["min_width"]) | (h < o["min_height"])
        if o["resolution_check_mode"] == "smart" and o["enable_size_filter"]:
            low = low & size.isNotNull()
        out = out.when(low, "resolution")
    return F.lit(None).cast("string") if out is F else out.otherwise(F.lit(None).cast("string"))
