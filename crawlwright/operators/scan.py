"""Pattern scan of source texts and of file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .columns import computed

# Fixed values: (pattern, finding, level) per category, advice and weakness ids.
PATTERNS = {
    "command_injection": [
        (r"subprocess\.call\([^)]*shell\s*=\s*True", "subprocess调用使用shell=True", "high"),
        (r"os\.system\s*\(", "使用os.system执行命令", "high"),
        (r"os\.popen\s*\(", "使用os.popen执行命令", "medium"),
        (r"subprocess\.Popen\([^)]*shell\s*=\s*True", "Popen调用使用shell=True", "high"),
    ],
    "path_traversal": [
        (r"open\s*\([^)]*\.\./.*\)", "可能的路径遍历攻击", "high"),
        (r"\.\./", "路径中包含../模式", "medium"),
        (r"%2e%2e%2f", "URL编码的路径遍历", "high"),
    ],
    "hardcoded_secrets": [
        (r"""password\s*=\s*["'][^"']{8,}["']""", "硬编码密码", "critical"),
        (r"""api_key\s*=\s*["'][^"']{16,}["']""", "硬编码API密钥", "critical"),
        (r"""secret\s*=\s*["'][^"']{16,}["']""", "硬编码密钥", "critical"),
        (r"""token\s*=\s*["'][^"']{16,}["']""", "硬编码令牌", "critical"),
    ],
    "sql_injection": [
        (r"execute\s*\([^)]*%.*%", "可能的SQL注入", "high"),
        (r"query\s*\([^)]*\+.*\+", "SQL查询字符串拼接", "medium"),
        (r"SELECT.*\+.*\+", "SQL SELECT语句拼接", "medium"),
    ],
    "unsafe_deserialization": [
        (r"pickle\.loads?\s*\(", "不安全的pickle反序列化", "high"),
        (r"eval\s*\(", "使用eval函数", "critical"),
        (r"exec\s*\(", "使用exec函数", "critical"),
    ],
    "weak_crypto": [
        (r"hashlib\.md5\s*\(", "使用弱加密算法MD5", "medium"),
        (r"hashlib\.sha1\s*\(", "使用弱加密算法SHA1", "medium"),
        (r"random\.random\s*\(", "使用不安全的随机数生成器", "low"),
    ],
    "file_permissions": [
        (r"chmod\s*\([^)]*777", "设置过于宽松的文件权限", "high"),
        (r"os\.chmod\s*\([^)]*0o777", "设置过于宽松的文件权限", "high"),
    ],
    "network_security": [
        (r"requests\.get\s*\([^)]*verify\s*=\s*False", "禁用SSL证书验证", "high"),
        (r"urllib.*verify\s*=\s*False", "禁用SSL证书验证", "high"),
        (r"ssl\._create_unverified_context", "创建未验证的SSL上下文", "high"),
    ],
}
ADVICE = {
    "command_injection": "使用参数化命令执行，避免shell=True，验证所有用户输入",
    "path_traversal": "使用os.path.abspath()和os.path.commonpath()验证路径，限制文件访问范围",
    "hardcoded_secrets": "将敏感信息存储在环境变量或安全的配置文件中",
    "sql_injection": "使用参数化查询或ORM，永远不要直接拼接SQL语句",
    "unsafe_deserialization": "避免使用pickle反序列化不可信数据，使用JSON等安全格式",
    "weak_crypto": "使用强加密算法如SHA-256或更高版本，使用secrets模块生成随机数",
    "file_permissions": "设置适当的文件权限，遵循最小权限原则",
    "network_security": "始终验证SSL证书，使用HTTPS进行敏感数据传输",
}
CWE = {
    "command_injection": "CWE-78", "path_traversal": "CWE-22", "hardcoded_secrets": "CWE-798",
    "sql_injection": "CWE-89", "unsafe_deserialization": "CWE-502", "weak_crypto": "CWE-327",
    "file_permissions": "CWE-732", "network_security": "CWE-295",
}
SENSITIVE_FILES = [r".*\.pem$", r".*\.key$", r".*\.p12$", r".*\.pfx$", r".*id_rsa.*", r".*id_dsa.*",
                   r".*\.ssh.*", r".*config$", r".*\.env$", r".*\.secret$"]
BACKUP_FILES = [r".*\.bak$", r".*\.backup$", r".*\.old$", r".*\.orig$", r".*~$"]
FILE_FINDINGS = {
    "sensitive_file": ("敏感文件发现", "发现可能包含敏感信息的文件: ", "medium", "确保敏感文件不被意外提交到版本控制系统"),
    "backup_file": ("备份文件发现", "发现备份文件: ", "low", "删除不必要的备份文件"),
}
LEVELS = ["low", "medium", "high", "critical"]


def category_title(category: str) -> str:
    return category.replace("_", " ").title()


def _sql(text: str) -> str:
    """A SQL string of exactly this text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_PART = "struct<size:int,back:int,line:string>"


def _events(text: str) -> str:
    """SQL array of a text's lines and of its matches per pattern, as lengths in order.

    ``size`` is how far each leads on from the one before, ``back`` how long it is itself.
    A text that no pattern matches has none.
    """
    found, regexes = [], [f"(?imd){pattern}" for patterns in PATTERNS.values() for pattern, _, _ in patterns]
    for at, regex in enumerate(map(_sql, regexes)):
        parts = (f"zip_with(split({text}, {regex}, -1), regexp_extract_all({text}, {regex}, 0), (gap, hit) -> named_struct("
                 "'size', length(gap) + coalesce(length(hit), 0), 'back', length(hit), 'line', CAST(NULL AS STRING)))")
        found.append(f"CASE WHEN {text} RLIKE {regex} THEN named_struct('stream', {at}, 'parts', CAST({parts} AS array<{_PART}>)) END")
    lines = (f"named_struct('stream', -1, 'parts', CAST(transform(split({text}, '\\n', -1), line -> named_struct("
             f"'size', length(line) + 1, 'back', length(line) + 1, 'line', line)) AS array<{_PART}>))")
    some = " OR ".join(f"{text} RLIKE {_sql(r)}" for r in regexes)
    return f"CASE WHEN {some} THEN array_compact(array({lines}, {', '.join(found)})) END"


def scan_texts(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per match of 24 patterns, with its line, level, advice and weakness id.

    The patterns are literals of one projection, so a text is read once. Of
    texts with a match, lines and matches are exploded as lengths; running sums give
    their places, and one pass over both in order gives every match the line it
    begins in, so a text with very many matches costs a sort. Texts without
    a match are not shuffled.
    """
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), F.col(path).alias("_path"), F.expr(_events(f"`{text}`")).alias("_events"))
    parts = rows.select("_row", "_path", F.inline("_events")).select("_row", "_path", "stream", F.posexplode("parts").alias("match_no", "part"))
    parts = parts.select("_row", "_path", "stream", "match_no", "part.*").repartition("_row")
    upto = Window.partitionBy("_row", "stream").orderBy("match_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("_start", F.sum(F.col("size").cast("bigint")).over(upto) - F.col("back")).filter("back IS NOT NULL")
    merged = Window.partitionBy("_row").orderBy("_start", "stream").rowsBetween(Window.unboundedPreceding, 0)
    hits = placed.select("*", F.count("line").over(merged).cast("int").alias("line_number"), F.last("line", True).over(merged).alias("_line"))
    known = [f"named_struct('category', {_sql(c)}, 'pattern', {_sql(p)}, 'title', {_sql(f'{category_title(c)}: {finding}')}, 'finding', {_sql(finding)}, "
             f"'level', {_sql(level)}, 'recommendation', {_sql(ADVICE[c])}, 'cwe_id', {_sql(CWE[c])})"
             for c, patterns in PATTERNS.items() for p, finding, level in patterns]
    hits = hits.filter("stream >= 0").select(
        F.col("_path").alias(path), F.col("stream").alias("pattern_no"), "match_no", "line_number", "_line",
        F.expr(f"inline(array(array({', '.join(known)})[stream]))"))
    seed = F.concat_ws("_", F.col(path).cast("string"), F.col("line_number").cast("string"), "pattern")
    return hits.select(
        F.concat(F.col("category"), F.lit("_"), F.substr(F.md5(seed), F.lit(1), F.lit(8))).alias("issue_id"),
        F.col(path), "category", "title",
        F.format_string("在文件 %s 第 %s 行发现 %s", F.col(path).cast("string"), F.col("line_number").cast("string"),
                        F.col("finding")).alias("description"),
        "level", "line_number", U.strip(F.col("_line")).alias("code_snippet"), "recommendation", "cwe_id",
        "pattern_no", "match_no")


def scan_file_names(files: DataFrame, path: str = "path") -> DataFrame:
    """sensitive and backup file names; a file may give one finding of each kind."""
    name = F.lower(F.regexp_extract(F.col(path), r"([^/]*)$", 1))
    groups = {"sensitive_file": SENSITIVE_FILES, "backup_file": BACKUP_FILES}
    found = []
    for kind, patterns in groups.items():
        title, text, level, advice = FILE_FINDINGS[kind]
        found.append(F.when(name.rlike("^(?:" + "|".join(patterns) + ")"), F.struct(
            F.lit(kind).alias("kind"), F.lit(title).alias("title"),
            F.concat(F.lit(text), F.col(path)).alias("description"), F.lit(level).alias("level"),
            F.lit(advice).alias("recommendation"))))
    rows = computed(files, _hits=F.array_compact(F.array(*found))).select(path, F.inline("_hits"))
    return rows.withColumn("issue_id", F.concat(
        F.col("kind"), F.lit("_"), F.substr(F.md5(F.col(path)), F.lit(1), F.lit(8))))
