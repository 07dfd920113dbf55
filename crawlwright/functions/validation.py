"""Validation rule sets: url, file path, file name, image url and free text.

A rule is a name, a predicate ``Column -> Column``, an error text and a level.
``validate`` evaluates all rules of a type at a level into one struct column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U

LEVELS = ["basic", "strict", "paranoid"]

# Word lists, patterns, limits and texts that results depend on.
MALICIOUS_PATTERNS = ["javascript:", "data:", "vbscript:", "file:", "ftp:", "<script", "</script>",
                      r"eval\(", r"exec\(", r"system\(", r"shell_exec\(", r"passthru\(",
                      r"\.\./", "%2e%2e%2f", "%252e%252e%252f"]
TRAVERSAL_TEXTS = ["../", "..\\", "%2e%2e%2f", "%2e%2e%5c", "..%2f", "..%5c",
                   "%252e%252e%252f", "%252e%252e%255c"]
SYSTEM_PATHS = ["/etc/", "/proc/", "/sys/", "/dev/", "/boot/", "C:/Windows/", "C:/System32/",
                "C:/Program Files/", "/usr/bin/", "/usr/sbin/", "/bin/", "/sbin/"]
EXECUTABLE_EXTS = ["exe", "bat", "cmd", "com", "scr", "pif", "sh", "bash", "zsh", "fish",
                   "py", "pl", "rb", "php", "js"]
DANGEROUS_EXTS = ["exe", "bat", "cmd", "com", "scr", "pif", "msi", "sh", "bash", "zsh", "fish",
                  "py", "pl", "rb", "php", "js", "vbs", "ps1"]
SAFE_EXTS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "svg", "txt", "log", "json",
             "xml", "csv", "zip", "rar", "7z", "tar", "gz"]
XSS_PATTERNS = ["<script[^>]*>.*?</script>", "javascript:", "vbscript:", r"onload\s*=", r"onerror\s*=",
                r"onclick\s*=", r"onmouseover\s*=", "<iframe[^>]*>", "<object[^>]*>", "<embed[^>]*>",
                "<link[^>]*>", "<meta[^>]*>"]
SQL_PATTERNS = [r"union\s+select", r"drop\s+table", r"delete\s+from", r"insert\s+into",
                r"update\s+.*\s+set", r"exec\s*\(", r"execute\s*\(", "sp_executesql", "xp_cmdshell",
                r";\s*--", r";\s*/\*", r"'\s*or\s*'", r"'\s*and\s*'", r"1\s*=\s*1", r"1\s*=\s*0"]
SHELL_PATTERNS = [r";\s*rm\s", r";\s*del\s", r";\s*cat\s", r";\s*type\s", r";\s*ls\s", r";\s*dir\s",
                  r";\s*wget\s", r";\s*curl\s", r";\s*nc\s", r";\s*netcat\s", r"\|\s*nc\s",
                  r"\|\s*netcat\s", "`.*`", r"\$\(.*\)", r"&&\s*rm\s", r"\|\|\s*rm\s"]
MAX_URL, MAX_PATH, MAX_NAME = 2048, 260, 255
# networks that are not globally reachable: (prefix, length), with the exceptions inside them
PRIVATE_V4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
              ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
              ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("100.64.0.0", 10)]
PUBLIC_V4 = [("192.0.0.9", 32), ("192.0.0.10", 32)]
# the same for IPv6, as patterns over all 32 hex digits
PRIVATE_V6 = ("^(0{31}[01]|0{20}ffff|0064ff9b0001|0100000000000000|20010[01]|20010db8|2002|3fff0|f[cd]|fe[89ab])")
PUBLIC_V6 = "^(20010001(0{23})[12]|20010003|200100040112|2001002|2001003)"
ERRORS = {
    "protocol": "URL必须以http://或https://开头", "url_length": "URL长度不能超过2048字符",
    "format": "URL格式无效", "domain": "域名不是可访问的公共域名", "malicious": "URL包含可疑模式",
    "ip": "不允许直接使用IP地址", "traversal": "路径包含目录遍历攻击", "path_length": "路径长度超过限制",
    "path_chars": "路径包含无效字符", "system_path": "不允许访问系统路径",
    "executable": "不允许访问可执行文件路径", "name_length": "文件名长度必须在1-255字符之间",
    "name_chars": "文件名包含无效字符", "reserved": "文件名是系统保留名称", "extension": "文件扩展名不安全",
    "image": "URL不是有效的图片格式", "size": "图片URL可能指向过大的文件", "xss": "输入包含XSS攻击模式",
    "sql": "输入包含SQL注入模式", "shell": "输入包含命令注入模式", "unknown": "未知的验证规则类型: %s",
    "failed": "验证规则 %s 执行失败: null",
}


def _any(patterns: list[str], flags: str = "(?d)") -> str:
    return flags + "|".join(patterns)


def host(url) -> Column:
    """Host name without user info, port and brackets, lower case."""
    loc = F.regexp_replace(F.lower(U.netloc(url)), "^.*@", "")
    return F.when(loc.startswith("["), F.regexp_extract(loc, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_extract(loc, "^([^:]*)", 1))


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _v4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p.try_cast("bigint"))


def _v4_in(number: Column, nets: list[tuple[str, int]]) -> Column:
    out = F.lit(False)
    for text, bits in nets:
        low = sum(int(p) << (8 * (3 - i)) for i, p in enumerate(text.split(".")))
        out = out | number.between(low, low + 2 ** (32 - bits) - 1)
    return out


def is_global_v4(text: Column) -> Column:
    return U.let(_v4_number(text), lambda n: _v4_in(n, PUBLIC_V4) | ~_v4_in(n, PRIVATE_V4))


def _full_v6(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address."""
    left = F.filter(F.split(F.regexp_extract(text, "^(.*?)(?:::|$)", 1), ":"), lambda x: x != "")
    right = F.filter(F.split(F.regexp_extract(text, "::(.*)$", 1), ":"), lambda x: x != "")
    fill = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    return F.array_join(F.transform(F.concat(left, F.array_repeat(F.lit("0"), fill), right),
                                    lambda g: F.lpad(g, 4, "0")), "")


def is_global_v6(text: Column) -> Column:
    """Reachability of an IPv6 address; mapped IPv4 addresses follow the IPv4 rule."""
    mapped = F.regexp_extract(text, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    return F.when(mapped != "", is_global_v4(mapped)).otherwise(U.let(
        _full_v6(text), lambda h: h.rlike(PUBLIC_V6) | ~h.rlike(PRIVATE_V6)))


def is_public_domain(url) -> Column:
    """Host is no local name; a literal address must be globally reachable, a name has a dot."""
    def test(h):
        return (F.when((h == "") | h.rlike(r"\s"), False)
                .when((h == "localhost") | h.endswith(".localhost") | h.endswith(".local"), False)
                .when(h.rlike(_V4), is_global_v4(h))
                .when(h.rlike("^[0-9a-f:.]*:[0-9a-f:.]*$"), is_global_v6(h))
                .otherwise(h.contains(".")))
    return U.let(F.rtrim(U.strip(host(url)), F.lit(".")), test)


def has_literal_ip(url) -> Column:
    loc = U.netloc(url)
    return loc.rlike(r"^(\d{1,3}\.){3}\d{1,3}(:.*)?$")


def has_traversal(path) -> Column:
    low = F.lower(U._c(path))
    out = F.lit(False)
    for t in TRAVERSAL_TEXTS:
        out = out | low.contains(t)
    return out


def has_valid_path_chars(path) -> Column:
    p = U._c(path)
    colon_free = F.when(p.rlike(r"^\p{L}:"), F.concat(F.substr(p, F.lit(1), F.lit(1)), F.substr(p, F.lit(3)))).otherwise(p)
    return ~p.rlike(r'[\x00-\x1f<>"|?*]') & ~colon_free.contains(":")


def is_system_path(path) -> Column:
    flat = F.regexp_replace(U.remove_dots(F.regexp_replace(U._c(path), "/+", "/")), "(?<=.)/$", "")
    flat = F.replace(flat, F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for s in SYSTEM_PATHS:
        out = out | flat.startswith(s)
    return out


def ends_with(value, exts: list[str]) -> Column:
    return F.lower(U._c(value)).rlike(r"\.(" + "|".join(exts) + ")$")


def has_xss(text) -> Column:
    """F28."""
    return F.lower(U._c(text)).rlike(_any(XSS_PATTERNS))


def has_sql_injection(text) -> Column:
    """F28."""
    return F.lower(U._c(text)).rlike(_any(SQL_PATTERNS))


def has_shell_injection(text) -> Column:
    """F28."""
    return U._c(text).rlike(_any(SHELL_PATTERNS))


@dataclass(frozen=True)
class Rule:
    """V1: one validation rule; ``check`` is true for a good value."""

    name: str
    check: Callable[[Column], Column]
    error: str
    level: str = "basic"
    sanitizer: Callable[[Column], Column] | None = None


def rule_set(kind: str, level: str = "strict") -> list[Rule] | None:
    """The rules of a kind; null for an unknown kind."""
    name_exts = (lambda v: ~ends_with(v, DANGEROUS_EXTS) & ends_with(v, SAFE_EXTS))
    url = [
        Rule("protocol_check", lambda v: v.rlike("^https?://"), ERRORS["protocol"]),
        Rule("length_check", lambda v: F.length(v) <= MAX_URL, ERRORS["url_length"]),
        Rule("format_check", U.is_absolute, ERRORS["format"]),
        Rule("domain_check", is_public_domain, ERRORS["domain"], "strict"),
        Rule("malicious_check", lambda v: ~F.lower(v).rlike(_any(MALICIOUS_PATTERNS)), ERRORS["malicious"], "strict"),
        Rule("ip_check", lambda v: ~has_literal_ip(v), ERRORS["ip"], "paranoid"),
    ]
    sets = {
        "url": url,
        "image_url": url + [
            Rule("image_extension_check", lambda v: U.is_image_url(v, "validated"), ERRORS["image"]),
            Rule("size_limit_check", lambda v: v.isNotNull(), ERRORS["size"])],
        "file_path": [
            Rule("path_traversal_check", lambda v: ~has_traversal(v), ERRORS["traversal"]),
            Rule("length_check", lambda v: F.length(v) <= MAX_PATH, ERRORS["path_length"]),
            Rule("invalid_chars_check", has_valid_path_chars, ERRORS["path_chars"]),
            Rule("system_path_check", lambda v: ~is_system_path(v), ERRORS["system_path"], "strict"),
            Rule("executable_check", lambda v: ~ends_with(v, EXECUTABLE_EXTS), ERRORS["executable"], "strict")],
        "filename": [
            Rule("length_check", lambda v: F.length(v).between(1, MAX_NAME), ERRORS["name_length"]),
            Rule("invalid_chars_check", lambda v: ~v.rlike(r'[\x00-\x1f<>:"/\\|?*]'), ERRORS["name_chars"]),
            Rule("reserved_names_check",
                 lambda v: ~F.regexp_extract(F.upper(v), "^([^.]*)", 1).isin(U.RESERVED_NAMES), ERRORS["reserved"]),
            Rule("extension_check", name_exts, ERRORS["extension"], "strict")],
        "user_input": [
            Rule("xss_check", lambda v: ~has_xss(v), ERRORS["xss"]),
            Rule("sql_injection_check", lambda v: ~has_sql_injection(v), ERRORS["sql"]),
            Rule("command_injection_check", lambda v: ~has_shell_injection(v), ERRORS["shell"])],
    }
    if kind not in sets:
        return None
    allowed = LEVELS[: LEVELS.index(level) + 1]
    return [r for r in sets[kind] if r.level in allowed]


def validate(value, kind: str, level: str = "strict", extra: list[Rule] = ()) -> Column:
    """``struct<valid,errors,sanitized>`` over all rules of a kind, errors in rule order.

    A rule whose check is null could not be evaluated and counts as an error.
    """
    v = U._c(value)
    rules = rule_set(kind, level)
    if rules is None and not extra:
        return F.struct(F.lit(False).alias("valid"), F.array(F.lit(ERRORS["unknown"] % kind)).alias("errors"),
                        v.alias("sanitized"))
    rules = [*(rules or []), *extra]
    # every rule is evaluated once, into an array the errors are read from
    checks = F.array(*[r.check(v) for r in rules])
    texts = F.array(*[F.struct(F.lit(r.error).alias("error"), F.lit(ERRORS["failed"] % r.name).alias("failed"))
                      for r in rules])
    errors = F.array_compact(F.zip_with(checks, texts, lambda ok, t: F.when(ok.isNull(), t["failed"]).when(~ok, t["error"])))
    sanitized, ok = v, F.lit(True)
    for r in rules if any(r.sanitizer for r in rules) else ():
        ok = ok & F.coalesce(r.check(v), F.lit(False))
        if r.sanitizer:
            sanitized = F.when(ok, r.sanitizer(sanitized)).otherwise(sanitized)
    return U.let(errors, lambda e: F.struct((F.size(e) == 0).alias("valid"), e.alias("errors"),
                                            sanitized.alias("sanitized")))
