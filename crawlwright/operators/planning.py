"""Crawl planning: generated pages, patterns, task validation, frontier, due tasks, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import links as L
from ..functions import urls as U
from . import ordered as O
from .columns import computed
from .dedupe import keep_first
from .joins import matching, with_directory_flag, with_task_flag

# Plan sizes and texts.
SEED_PAGES, PAGES_PER_SEED = 3, 20
CHECKED_PAGES, CHECKED_PAGES_FAST, ENOUGH_PAGES, EXTRA_PAGES = 30, 50, 10, 20
REASONS = {
    "format": "无效的URL格式", "network": "网络不可达或页面不存在", "directory": "目录已存在: ",
    "task": "相同URL的任务已存在", "no_images": "页面可能不包含图片内容",
    "dead": "页面无法访问且可能不包含图片", "skipped": "跳过已存在的任务", "bad_pattern_url": "无效的URL: ",
}
PREVIEW = {"new": "新建", "directory": "目录已存在", "task": "任务已存在", "invalid": "无效",
           "size": "约50MB", "no_size": "未知"}
EXPECTED_IMAGES = 50

#: Numbers of a pattern's range in one row.
RANGE_PIECE = 10_000


# -------------------------------------------------------- generated pages

def generated_pages(seeds: DataFrame, group: str = "main_url", count: int = PAGES_PER_SEED,
                    seed_pages: int = SEED_PAGES) -> DataFrame:
    """Siblings of the first three seed pages of a group, first occurrence of each.

    ``seeds(group, pos, url)``; only pages that pass F22 generate.
    """
    rows = seeds.filter((F.col("pos") < seed_pages) & L.is_generation_seed("url"))
    made = rows.select(group, "pos", F.posexplode(U.sibling_urls("url", count)).alias("i", "url"))
    return keep_first(made, [group, "url"], ["pos", "i"])


def pattern_urls(patterns: DataFrame, last: str | None = None) -> DataFrame:
    """U16: ``base_url, index, pattern, position, raw_url``, a row per url of each pattern, positions from 0.

    A range is cut into pieces, and those into smaller ones, so no row holds
    more than some thousand numbers and one pattern's pieces spread over the
    tasks. ``last`` names a column with the last position that is wanted
    (null: all), which comes back too; no piece beyond it is made.
    """
    keep = ["base_url", "index", "pattern", *([last] if last else [])]
    wanted = lambda position: F.lit(True) if last is None else F.col(last).isNull() | (position <= F.col(last))
    pieces = patterns.select(*keep, F.inline(U.pattern_ranges("pattern")))
    for step in (RANGE_PIECE ** 2, RANGE_PIECE):
        start = pieces.select(*keep, "low", "high", "before", F.explode(F.sequence("low", "high", F.lit(step).cast("bigint"))).alias("start"))
        pieces = start.select(*keep, F.col("start").alias("low"), (F.col("start") + F.least(
            F.col("high") - F.col("start"), F.lit(step - 1).cast("bigint"))).alias("high"), (F.col("before") + F.col("start") - F.col("low")).alias("before"))
        pieces = pieces.filter(wanted(F.col("before")))
    # a stated number of partitions, as rows as short as pieces would all be merged into one
    spread = int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = pieces.repartition(spread, "base_url", "pattern", "before").select(
        *keep, "low", "before", F.explode(F.sequence("low", "high")).alias("number"))
    ranged = computed(numbers, position=F.col("before") + F.col("number") - F.col("low"),
                      raw_url=U.numbered_url("pattern", "number")).select(*keep, "position", "raw_url")
    chosen = patterns.select(*keep, F.posexplode(U.pattern_choices("base_url", "pattern")).alias("position", "raw_url"))
    return ranged.unionByName(chosen.withColumn("position", F.col("position").cast("bigint"))).filter(wanted(F.col("position")))


def expanded_patterns(patterns: DataFrame, name_template: str | None = None) -> DataFrame:
    """One task row per url of each pattern; ``patterns(base_url, index, pattern)``.

    The first url that cannot be crawled stops the rest of its pattern: it
    stays as a row with an error, the ones after it are left out. Only the
    patterns meet their first bad place in a join, the urls are made again.
    """
    own = ["base_url", "index", "pattern"]
    urls = pattern_urls(patterns)
    judged = computed(urls, _good=U.is_crawlable(U.preprocess("raw_url")))
    bad = judged.filter(~F.col("_good")).groupBy(*own).agg(F.min("position").alias("_bad")).select(
        *[F.col(c).alias(f"_{c}") for c in own], "_bad")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own]
    rows = pattern_urls(patterns.select(*own).join(bad, same, "left"), "_bad").withColumnRenamed("position", "_i")
    rows = computed(rows, url=U.preprocess("raw_url"))
    name = F.lit(None).cast("string") if name_template is None else F.replace(F.replace(
        F.lit(name_template), F.lit("{index}"), F.col("index").cast("string")),
        F.lit("{url_index}"), (F.col("_i") + 1).cast("string"))
    return rows.select(
        "base_url", "index", "pattern", (F.col("_i") + 1).alias("url_index"), "raw_url", "url",
        name.alias("name"), F.when(F.col("_i") == F.col("_bad"), F.concat(
            F.lit(REASONS["bad_pattern_url"]), F.col("raw_url"))).alias("error"))


# -------------------------------------------------------- task validation

def validate_tasks(urls: DataFrame, tasks: DataFrame, directories: DataFrame, status: DataFrame,
                   skip_existing: bool = True) -> DataFrame:
    """one row per distinct url with its flags, validity and the reason written last.

    ``status(url, status, has_images)`` stands for the network check; a url
    that is not in it is unreachable.
    """
    rows = with_task_flag(O.stored(urls.select("url").distinct()), tasks)
    rows = with_directory_flag(rows.withColumn("directory_name", U.task_directory("url")), directories)
    s = status.select("url", (F.col("status") < 400).alias("_up"), F.col("has_images").alias("_img"))
    rows = matching(rows, s, ["url"], "left")
    ok = U.is_absolute("url")
    up = ok & F.coalesce("_up", F.lit(False))
    img = up & F.coalesce("_img", F.lit(False))
    dup = ok & (F.col("directory_exists") | F.col("task_exists"))
    reason = (F.when(~ok, REASONS["format"])
              .when(dup & F.lit(skip_existing), REASONS["skipped"])
              .when(~dup & ~up, REASONS["dead"])
              .when(up & ~img, REASONS["no_images"])
              .when(F.col("task_exists"), REASONS["task"])
              .when(F.col("directory_exists"), F.concat(F.lit(REASONS["directory"]), F.col("directory_name")))
              .otherwise(F.lit("")))
    # an ill-formed url is left before anything else is looked at: its flags keep their defaults
    return rows.select(
        "url", "directory_name", (ok & ~dup & up).alias("is_valid"), reason.alias("reason"),
        (~ok | up).alias("network_accessible"), (ok & F.col("directory_exists")).alias("directory_exists"),
        (ok & F.col("task_exists")).alias("task_exists"), img.alias("has_images"))


def preview_tasks(validated: DataFrame) -> DataFrame:
    """What a user sees before the tasks are made."""
    status = (F.when(F.col("is_valid"), PREVIEW["new"]).when(F.col("directory_exists"), PREVIEW["directory"])
              .when(F.col("task_exists"), PREVIEW["task"]).otherwise(PREVIEW["invalid"]))
    has = F.col("has_images")
    return validated.select(
        "url", F.when(has, EXPECTED_IMAGES).otherwise(0).alias("estimated_images"),
        F.when(has, PREVIEW["size"]).otherwise(PREVIEW["no_size"]).alias("estimated_size"), "directory_name",
        status.alias("status"), F.col("is_valid").alias("selected"),
        F.when(~F.col("is_valid"), F.col("reason")).alias("error_message"))


def task_rows(validated: DataFrame, download_path: str, scheduled_time=None) -> DataFrame:
    """One task per valid url, named after its directory."""
    when = F.lit(scheduled_time).cast("timestamp")
    return validated.filter("is_valid").select(
        F.col("directory_name").alias("name"), F.col("url").alias("base_url"),
        F.lit(download_path).alias("download_path"), F.lit(1).alias("max_depth"), when.alias("scheduled_time"))


# ------------------------------------------------------------- the plan

def checked_pages(pages: DataFrame, group: str = "main_url", fast: bool = False) -> DataFrame:
    """T5: of the first 30 pages keep the valid ones; add the next 20 unchecked when fewer than 10 are left.

    ``pages(group, pos, url, valid)``. Positions are dense, so the budget is a
    filter; the count of valid pages is an aggregate, not a window.
    """
    n = CHECKED_PAGES_FAST if fast else CHECKED_PAGES
    head = pages.filter(F.col("pos") < n + EXTRA_PAGES)
    valid = U.is_absolute("url") if fast else F.col("valid")
    head = head.withColumn("_keep", (F.col("pos") < n) & F.coalesce(valid, F.lit(False)))
    kept = F.count_if("_keep").over(Window.partitionBy(group))
    return (head.withColumn("_n", kept)
            .filter(F.col("_keep") | ((F.col("pos") >= n) & (F.col("_n") < ENOUGH_PAGES))).drop("_keep", "_n"))


def limited_pages(found: DataFrame, generated: DataFrame, max_pages: int, group: str = "main_url") -> DataFrame:
    """T4: found pages, then generated ones where fewer than half of the limit were found, cut to the limit."""
    counts = found.groupBy(group).agg(F.count("*").alias("_found"))
    extra = generated.join(counts, group, "left").filter(
        F.coalesce("_found", F.lit(0)) < max_pages // 2).drop("_found")
    rows = found.withColumn("tier", F.lit(0)).unionByName(extra.withColumn("tier", F.lit(1)))
    order = Window.partitionBy(group).orderBy("tier", "pos")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_pages)


def frontier(seeds: DataFrame, edges: DataFrame, max_depth: int = 1) -> DataFrame:
    """Urls reached from the seeds, with the depth they are first reached at.

    ``seeds(task, url)``, ``edges(src, dst)``. One join per level; a level is
    the neighbours of the one before without what was visited. From the second
    level on, the visited table is checkpointed, so the lineage stays short.
    """
    visited = seeds.select("task", "url").distinct().withColumn("depth", F.lit(0))
    level = visited
    for depth in range(1, max_depth + 1):
        reached = (level.join(edges, F.col("url") == F.col("src")).select("task", F.col("dst").alias("url")).distinct()
                   .join(visited.select("task", "url"), ["task", "url"], "left_anti")
                   .withColumn("depth", F.lit(depth)))
        if max_depth > 1:
            reached = O.checkpointed(reached)
            if reached.isEmpty():
                break
        visited, level = visited.unionByName(reached), reached
        if max_depth > 1:
            visited = O.checkpointed(visited)
    return visited


# ------------------------------------------------------------- due tasks

def due_tasks(tasks: DataFrame, now) -> DataFrame:
    """Scheduled tasks whose time has come, by time and then priority."""
    t = F.lit(now).cast("timestamp")
    return tasks.filter(F.col("scheduled_time") <= t).orderBy("scheduled_time", "priority")


def due_repeats(tasks: DataFrame, now) -> DataFrame:
    """Completed tasks whose repeat interval has passed, as new task rows."""
    t = F.lit(now).cast("timestamp")
    next_time = F.col("completed_time") + F.make_dt_interval(mins=F.col("repeat_minutes"))
    return (tasks.filter((F.col("status") == "completed") & (F.col("repeat_minutes") > 0) & (next_time <= t))
            .withColumn("next_time", next_time).withColumn("name", F.concat("name", F.lit(" (重复)"))))


# ---------------------------------------------------------- unique names

def _numbered_name(name: Column, n: Column, is_file: bool) -> Column:
    stem = U.stem(name) if is_file else name
    tail = F.substr(name, F.length(stem) + 1)
    return F.when(n == 0, name).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), tail))


def unique_names(rows: DataFrame, taken: DataFrame, order: list[str], name: str = "name", is_file: bool = False,
                 rows_per_chunk: int = O.ROWS_PER_CHUNK) -> DataFrame:
    """First free of name, name_1, name_2 ... for every row, in order; ``taken(name)`` is not free.

    Rows of a name number through its free suffixes: the k-th row takes the
    k-th suffix no taken name uses. Different names can meet at one result
    ('a_1' and the second 'a'), but only within a family, the names that are
    equal without trailing numbers. A round therefore settles each family up
    to its first loser; the settled names count as taken in the next round.
    """
    cols = rows.columns
    left, done = rows, None
    used = taken.select(F.col(name).alias("_used")).distinct()
    while True:
        ranked = O.numbered(left, [name], order, "_k", rows_per_chunk)
        wants = left.groupBy(name).agg(F.count("*").alias("_rows"))
        # the suffixes a name has lost to taken names
        lost = used.select("_used", U.stem(F.col("_used")).alias("_s") if is_file else F.col("_used").alias("_s"),
                           (F.substr("_used", F.length(U.stem(F.col("_used"))) + 1) if is_file else F.lit("")).alias("_t"))
        lost = lost.select(
            F.explode(F.array(
                F.struct(F.col("_used").alias("n"), F.lit(0).cast("bigint").alias("i")),
                F.struct(F.concat(F.regexp_extract("_s", r"^(.*)_[1-9][0-9]*$", 1), F.col("_t")).alias("n"),
                         F.regexp_extract("_s", r"_([1-9][0-9]*)$", 1).try_cast("bigint").alias("i")))).alias("x"))
        lost = lost.select(F.col("x.n").alias(name), F.col("x.i").alias("_i")).filter("_i is not null").distinct()
        # k-th free suffix: shift k by the taken suffixes at or below it, counted in suffix order
        spots = lost.join(wants.select(name), name, "left_semi")
        spots = O.numbered(spots, [name], ["_i"], "_j", rows_per_chunk)
        # taken suffix i is the j-th; free suffixes below it: i - (j - 1)
        gaps = spots.select(name, (F.col("_i") - F.col("_j") + 1).alias("_free"), F.col("_j").alias("_j"))
        marks = ranked.select(*cols, (F.col("_k") - 1).alias("_free"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_j"))
        marks = marks.unionByName(gaps.select(name, "_free", F.lit(0).alias("_kind"), "_j"), allowMissingColumns=True)
        shifted = O.running(marks, [name], ["_free", "_kind"], {"_shift": O.Running("max", F.col("_j"))}, rows_per_chunk)
        picked = shifted.filter("_kind = 1").withColumn("_n", F.col("_free") + F.coalesce("_shift", F.lit(0)))
        picked = picked.withColumn("unique_name", _numbered_name(F.col(name), F.col("_n"), is_file)).select(
            *cols, "unique_name")
        first = picked.groupBy("unique_name").agg(
            F.min_by(F.struct(*order), F.struct(*order)).alias("_first"), F.count("*").alias("_c"))
        stem = U.stem(F.col(name)) if is_file else F.col(name)
        family = F.concat(F.regexp_replace(stem, r"(?:_[1-9][0-9]*)+$", ""), F.substr(F.col(name), F.length(stem) + 1))
        judged = O.checkpointed(picked.join(first, "unique_name").withColumn(
            "_wins", F.struct(*order) == F.col("_first")).withColumn("_family", family))
        losers = judged.filter("not _wins").groupBy("_family").agg(F.min(F.struct(*order)).alias("_lost"))
        settled = O.checkpointed(judged.join(losers, "_family", "left").withColumn(
            "_settled", F.col("_lost").isNull() | (F.struct(*order) < F.col("_lost"))))
        won = settled.filter("_settled").select(*cols, "unique_name")
        done = won if done is None else O.checkpointed(done.unionByName(won))
        left = settled.filter("not _settled").select(*cols)
        if left.isEmpty():
            return done
        used = O.checkpointed(used.unionByName(won.select(F.col("unique_name").alias("_used"))).distinct())
