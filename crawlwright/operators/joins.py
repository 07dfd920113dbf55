"""Joins: what exists already, duplicate tasks, status tables, progress overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import images as I
from ..functions import urls as U
from . import ordered as O
from .columns import computed
from .dedupe import keep_last

# Similarity above which two task urls are the same task, and status limits.
SIMILAR = 0.9
REACHABLE_BELOW = 400
IMAGE_CONTENT_TYPES = ["image/jpeg", "image/png", "image/gif", "image/webp"]

_GRAM = 4
# paths of 19 characters and more have blocks enough for all their edits; below that there is one edit at most
_LONG = 19
_ONE_EDIT_MAX = 20
_SALTS = 16
_EDIT_STEPS = (1, 2, 4, 8, 16, 32, 64, 256)
# a beginning that so many known paths share is compared once for all of them, if what follows is no longer than that; so is an ending
_COMMON_HEAD = 1000
_TAIL_MAX = 16
_TAIL_EDITS = 2
# known paths whose many keys go to one task
_KEYED_PER_TASK = 50_000
# up to so many classes of known paths are told apart when their keys are made
_CLASSES_MAX = 64


def matching(left: DataFrame, right: DataFrame, on: list[str], how: str, width: int | None = None) -> DataFrame:
    """Join by merging; a hash of the keys leads them, as texts with the same beginning take long to sort."""
    dealt = lambda df: df if width is None else df.repartition(width, "_hash", *on)
    hashed = lambda df: dealt(df.withColumn("_hash", F.xxhash64(*on)))
    return hashed(left).join(hashed(right).hint("merge"), ["_hash", *on], how).drop("_hash")


# ---------------------------------------------------------- existing files

def without_existing_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """Drop images whose target (dir, filename) is stored completely and in a sane size.

    Incomplete files do not count, so their images stay and are fetched again.
    """
    good = files.filter(I.is_complete_file("length") & I.is_reasonable_file("length"))
    return images.join(good.select("dir", "filename").distinct(), ["dir", "filename"], "left_anti")


def with_directory_flag(urls: DataFrame, directories: DataFrame, name: str = "directory_name") -> DataFrame:
    """Is there a directory of that name? ``directories(directory_name)``."""
    known = directories.select(F.col("directory_name").alias(name)).distinct().withColumn(
        "directory_exists", F.lit(True))
    return matching(urls, known, [name], "left").withColumn(
        "directory_exists", F.coalesce("directory_exists", F.lit(False)))


# --------------------------------------------------------- duplicate tasks

def _max_edits(length: Column) -> Column:
    """Most edits that keep the similarity strictly above 0.9: the longer path decides."""
    return (F.floor((length - 1) / 10)).cast("int")


def _paths(df: DataFrame, url: str) -> DataFrame:
    return df.select(U.netloc(url).alias("host"), U.bare_path(url).alias("path")).filter(
        "path <> ''").distinct()


def _width(rows: DataFrame, keyed: int) -> int:
    """Partitions for the keys of so many paths: Spark takes the keys to be as few as the paths."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keyed // _KEYED_PER_TASK))


def _lengths(paths: DataFrame) -> dict[int, int]:
    """How many short paths have which length."""
    n = F.length("path")
    return {r["n"]: r["count"] for r in paths.filter(n <= _ONE_EDIT_MAX).groupBy(n.alias("n")).count().collect()}


def _one_edit_keys(paths: DataFrame, kind: str, lengths: list[int]) -> DataFrame:
    """``key``: the path itself, without one of its characters, or with one masked."""
    rows, p, n = paths.filter(F.length("path").isin(lengths)), F.col("path"), F.length("path")
    if kind == "whole":
        return rows.select("host", "path", p.alias("key"))
    return rows.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.substr(p, F.lit(1), i - 1), F.lit("\x00" if kind == "masked" else ""), F.substr(p, i + 1)))).alias("key"))


def _by_one_edit(probe: DataFrame, known: DataFrame) -> DataFrame:
    """Short paths of the probe side that are one edit away from a known one; no pairs are formed.

    Two paths share a key exactly when one edit turns one into the other. Keys
    that no path of the other side has the length for are not made.
    """
    of_probe, of_known = _lengths(probe), _lengths(known)
    width, found = _width(known, sum(of_known.values())), probe.select("host", "path").filter(F.lit(False))
    for mine, other, longer in (("masked", "masked", 0), ("whole", "cut", 1), ("cut", "whole", -1)):
        # an insertion makes the longer path the one that is cut, and it must allow an edit
        both = [n for n in of_probe if n + longer in of_known and n + max(longer, 0) > 10]
        if both:
            keys = _one_edit_keys(known, other, [n + longer for n in both]).select("host", "key")
            found = found.unionByName(matching(_one_edit_keys(probe, mine, both), keys, ["key", "host"], "left_semi", width).select("host", "path"))
    return found.distinct()


def _grams(step: int) -> Column:
    at = F.sequence(F.lit(1), F.length("path") - _GRAM + 1, F.lit(step))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.substr("path", i, F.lit(_GRAM)).alias("gram")))


def _by_rare_grams(probe: DataFrame, known: DataFrame) -> DataFrame:
    """Longer paths: d edits leave all but d of the known path's blocks untouched.

    So it is enough to look for d + 1 of them, near their place, and those are
    chosen that fewest probe paths hold. Common beginnings and endings of a
    large host are never looked for unless a path has nothing rarer.
    """
    longest = F.floor(F.length("path") / 0.9 + 1)
    usable = F.length("path") >= _LONG
    blocks = known.filter(usable).select("host", "path", F.explode(_grams(_GRAM)).alias("b")).select(
        "host", "path", "b.*")
    near = _max_edits(longest)
    looked = probe.filter(usable).select(
        "host", "path", (F.pmod(F.xxhash64("path"), F.lit(_SALTS))).cast("int").alias("salt"),
        F.explode(_grams(1)).alias("g")).select(
        "host", "path", "salt", F.col("g.gram").alias("gram"), F.explode(F.filter(
            F.sequence(F.greatest(F.col("g.at") - near, F.lit(1)), F.col("g.at") + near),
            lambda i: i % _GRAM == 1)).alias("k_at"))
    seen = looked.groupBy("host", "gram", "k_at").agg(F.count("*").alias("n")).withColumnRenamed("k_at", "at")
    order = Window.partitionBy("host", "path").orderBy(F.coalesce("n", F.lit(0)), "at")
    ranked = blocks.join(seen.hint("merge"), ["host", "at", "gram"], "left").withColumn("rank", F.row_number().over(order))
    index = ranked.filter((F.col("rank") <= _max_edits(longest) + 1) & F.col("n").isNotNull()).select(
        "host", "gram", F.col("at").alias("k_at"), F.col("path").alias("k_path"))
    # a block many paths share is spread over salts: the known side is repeated, the probe side split
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    on = ["host", "gram", "k_at", "salt"]
    # comparing costs far more than the rows weigh, so the width must not shrink with their size
    width = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _semi(looked.repartition(width, *on).alias("l"), index.repartition(width, *on).alias("r"), on)


def _around_last_number(paths: DataFrame, head: str) -> DataFrame:
    """Long paths cut before their last number, ``head`` and ``tail``; without a number the tail is empty."""
    cut = paths.filter(F.length("path") >= _LONG).withColumn("tail", F.regexp_extract("path", "[0-9]+[^0-9]*$", 0))
    return cut.withColumn(head, F.substr("path", F.lit(1), F.length("path") - F.length("tail")))


def _with_common_head(known: DataFrame) -> DataFrame:
    """Known paths whose ``head``, what stands before the last number, many share; ``class`` numbers head and ending.

    A path is ``head``, ``middle`` and ``ending``. The ending is what follows
    the number where many of the head's paths have it, else empty, so there
    are far fewer classes than paths.
    """
    n = F.length("tail")
    cut = _around_last_number(known, "head").withColumn("end", F.when(n.between(1, _TAIL_MAX), F.regexp_extract("tail", "[^0-9]*$", 0)))
    counts = cut.filter("end is not null").groupBy("host", "head", "end").agg(F.count("*").alias("n"))
    heads = counts.groupBy("host", "head").agg(F.sum("n").alias("n")).filter(F.col("n") >= _COMMON_HEAD).select("host", "head")
    common = O.checkpointed(matching(counts, heads, ["host", "head"], "left_semi").select(
        "host", "head", "end", F.when(F.col("n") >= _COMMON_HEAD, F.col("end")).otherwise("").alias("ending")))
    classes = O.checkpointed(common.select("host", "head", "ending").distinct().withColumn("class", F.monotonically_increasing_id()))
    # a head many paths share is spread over salts
    common = matching(common, classes, ["host", "head", "ending"], "inner").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(_SALTS)).cast("int"))
    return matching(salted, common, ["host", "head", "end", "salt"], "inner").select(
        "host", "path", "head", "ending", "class", F.substr("tail", F.lit(1), n - F.length("ending")).alias("middle"))


def _fewer(text: Column, most: Column) -> Column:
    """The text and what is left of it without one or two of its characters, at most ``most`` of them."""
    cuts = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(
        F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(
        F.array(text), F.when(most >= 1, cuts(text)).otherwise(F.array().cast("array<string>")),
        F.when(most >= 2, F.flatten(F.transform(cuts(text), cuts))).otherwise(F.array().cast("array<string>"))))


def _range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _edits(a: Column, b: Column, most: Column) -> Column:
    """Edits from one text to the other, -1 if there are more than ``most``."""
    return F.call_function("levenshtein", a, b, most)


def _most_edits(path: str | Column) -> Column:
    """Most edits between a path and any known one."""
    return _max_edits(F.floor(F.length(path) / 0.9 + 1))


def _may_begin(own: Column, head: Column, most: Column) -> Column:
    """May a path that begins with ``own`` be that many edits from one that begins with ``head``: one is close to a beginning of the other."""
    n, at = F.length(own), F.length(head)
    both = F.least(n, at)
    begin = lambda text, c: F.substr(text, F.lit(1), c)
    shorter = F.exists(_range(F.greatest(at - most, F.lit(0)), F.least(at + most, n)), lambda c: _edits(begin(own, c), head, most) >= 0)
    longer = F.exists(_range(F.greatest(n - most, F.lit(0)), F.least(n + most, at)), lambda c: _edits(own, begin(head, c), most) >= 0)
    return (_edits(begin(own, both), begin(head, both), 2 * most) >= 0) & (shorter | longer)


def _cuts(low: Column, high: Column, edits) -> Column:
    """``array<struct<at,e>>``: where a path may be cut, and the edits beside the cut (-1: too many)."""
    return F.transform(_range(low, high), lambda c: F.struct(c.alias("at"), edits(c).alias("e")))


def _best(cuts: Column) -> Column:
    """Cuts without those that a neighbour is an edit better than: what the neighbour saves pays for moving there."""
    beside = lambda i: F.coalesce(F.get(cuts, i)["e"], F.lit(-1))
    return F.filter(cuts, lambda x, i: (x["e"] == 0) | ((x["e"] > 0) & (beside(i - 1) != x["e"] - 1) & (beside(i + 1) != x["e"] - 1)))


def _cut_like(probe: DataFrame, members: DataFrame) -> DataFrame:
    """Paths of the probe side cut as a class of known paths is: ``class, rest, middle, spent``.

    Wherever a known path is cut, some cut of a path d edits away splits the d
    edits into those of the heads, of the middles and of the endings. ``spent``
    counts those of heads and endings, ``rest`` the characters of the class's
    head and ending. Heads are compared once for all paths that share them.
    """
    width = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    salt = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    classes = members.select("host", "head", "ending", "class").distinct().groupBy("host", "head").agg(
        F.collect_list(F.struct("class", "ending")).alias("classes")).withColumn("salt", salts(width))
    cut = _around_last_number(probe, "own")
    owns = cut.groupBy("host", "own").agg(F.max(F.length("path")).alias("longest")).withColumn("salt", salt("own", width))
    most = _max_edits(F.floor(F.col("longest") / 0.9 + 1))
    pairs = owns.repartition(width, "host", "salt").join(
        classes.repartition(width, "host", "salt").hint("merge"), ["host", "salt"]).filter(
        (F.col("longest") >= F.length("head") - most) & _may_begin(F.col("own"), F.col("head"), most))
    pairs = O.checkpointed(pairs.select("host", "own", "head", "classes")).withColumn("salt", salts(_SALTS))
    rows = matching(cut.withColumn("salt", salt("path", _SALTS)), pairs, ["host", "own", "salt"], "inner")
    n, at, p, most = F.length("path"), F.length("head"), F.col("path"), F.col("most")
    rows = rows.select("host", "path", "head", "classes", _most_edits("path").alias("most"))
    rows = computed(rows, first=_cuts(F.greatest(at - most, F.lit(0)), F.least(at + most, n), lambda c: _edits(
        F.substr(p, F.lit(1), c), F.col("head"), most))).filter(F.exists("first", lambda x: x["e"] >= 0))
    rows = rows.select("host", "path", "most", "first", at.alias("at"), F.inline("classes"))
    end = n - F.length("ending")
    rows = computed(rows, last=_cuts(F.greatest(end - most, F.lit(0)), F.least(end + most, n), lambda c: _edits(
        F.substr(p, c + 1), F.col("ending"), most))).filter(F.exists("last", lambda x: x["e"] >= 0))
    rows = computed(rows, firsts=_best(F.col("first")), lasts=_best(F.col("last")))
    # best cuts that would cross are no pair, and worse ones may be
    apart = F.array_max("firsts.at") <= F.array_min("lasts.at")
    either = lambda best, each: F.when(apart, F.col(best)).otherwise(F.filter(each, lambda x: x["e"] >= 0))
    both = F.flatten(F.transform(either("firsts", "first"), lambda x: F.transform(either("lasts", "last"), lambda y: F.struct(
        x["at"].alias("low"), y["at"].alias("high"), (x["e"] + y["e"]).alias("spent")))))
    rows = rows.select("host", "path", "most", "class", (F.col("at") + F.length("ending")).alias("rest"), F.inline(both))
    return rows.filter("low <= high and spent <= most").select("host", "path", "class", "rest", "spent", F.substr(
        p, F.col("low") + 1, F.col("high") - F.col("low")).alias("middle"))


def _per_class(rows: DataFrame, **values: Column) -> dict[int, tuple] | None:
    """Aggregates of each class's rows; None if the classes are too many to be told apart."""
    got = rows.groupBy("class").agg(*[c.alias(n) for n, c in values.items()]).limit(_CLASSES_MAX + 1).collect()
    return {r["class"]: r for r in got} if len(got) <= _CLASSES_MAX else None


def _of_class(of: dict[int, tuple], value, otherwise: Column) -> Column:
    out = otherwise
    for k, r in of.items():
        out = F.when(F.col("class") == k, value(r)).otherwise(out)
    return out


def _shorter_keys(rows: DataFrame, cut: Column) -> DataFrame:
    """``key``: the middle without its last ``cut`` characters."""
    return rows.withColumn("cut", cut).withColumn("key", F.substr(
        "middle", F.lit(1), F.greatest(F.length("middle") - F.col("cut"), F.lit(0))))


def _fewer_keys(rows: DataFrame, most: Column) -> DataFrame:
    """``key``: a hash of the middle and of what is left of it without one or two characters; whoever joins by it compares the middles."""
    hashes = F.array_distinct(F.transform(_fewer(F.col("middle"), most), lambda x: F.xxhash64("class", x)))
    return rows.select("*", F.explode(hashes).alias("key"))


def _by_heads(probe: DataFrame, members: DataFrame, headed: int) -> DataFrame:
    """Paths of the probe side close to a known one of ``members``, so many, whose heads are few.

    Exact, each step only for what the one before left open: middles that are
    the same but for as many last characters as there may be edits (a key a
    path), middles two edits apart (they share a text that is left without two
    characters), and middles that may be further apart, compared with those of
    their class that have a length within the edits.
    """
    near = O.stored(_cut_like(probe, members))
    size, left = F.length("middle"), _most_edits("path") - F.col("spent")
    # no more edits than characters that are left out
    sure = F.least(_max_edits(F.length("path")) - F.col("spent"), F.lit(_TAIL_MAX))
    of = _per_class(near.filter(sure >= 0), sure=F.collect_set(sure))
    every = lambda: F.array(*[F.lit(r[0]) for r in near.filter(sure >= 0).select(sure).distinct().collect()]).cast("array<int>")
    cuts = every() if of is None else _of_class(of, lambda r: F.array(*[F.lit(x) for x in r["sure"]]), F.array().cast("array<int>"))
    tails = members.withColumn("_cuts", cuts).select("class", "middle", F.explode("_cuts").alias("_cut"))
    found = O.checkpointed(matching(
        _shorter_keys(near.filter(sure >= 0), sure), _shorter_keys(tails, F.col("_cut")).select("class", "cut", "key"),
        ["key", "class", "cut"], "left_semi").select("host", "path").distinct())

    open_ = O.stored(matching(near, found, ["host", "path"], "left_anti"))
    of = _per_class(open_, edits=F.max(F.least(left, F.lit(_TAIL_EDITS))), low=F.min(size - left), high=F.max(size + left))
    if of == {}:
        return found
    wanted = members.select("class", F.col("middle"))
    if of is not None:
        wanted = wanted.filter(_of_class(of, lambda r: size.between(r["low"], r["high"]), F.lit(False)))
    edits = F.lit(_TAIL_EDITS) if of is None else _of_class(of, lambda r: F.lit(r["edits"]), F.lit(0))
    keys = _fewer_keys(open_.filter(size <= _TAIL_MAX + _TAIL_EDITS), F.least(left, F.lit(_TAIL_EDITS)))
    texts = _fewer_keys(wanted, edits).select("class", "key", F.col("middle").alias("k_middle"))
    on = ["key", "class"]
    keys, texts = (x.repartition(_width(probe, headed), *on) for x in (keys, texts))
    found = found.unionByName(O.checkpointed(_semi(keys.alias("l"), texts.alias("r"), on)))

    open_ = O.checkpointed(matching(open_.filter(left > _TAIL_EDITS), found, ["host", "path"], "left_anti"))
    of = _per_class(open_, low=F.min(size - left), high=F.max(size + left))
    if of == {}:
        return found
    if of is not None:
        wanted = wanted.filter(_of_class(of, lambda r: size.between(r["low"], r["high"]), F.lit(False)))
    # the few that are still open meet a share of their class in each of many places
    width = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lengths = open_.select("*", F.explode(_range(F.greatest(size - left, F.lit(0)), F.least(size + left, F.lit(_TAIL_MAX)))).alias("size"))
    lengths = lengths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    whole = wanted.select("class", F.col("middle").alias("k_middle"), size.alias("size"), F.pmod(F.xxhash64("middle"), F.lit(_SALTS)).cast("int").alias("salt"))
    on = ["class", "size", "salt"]
    return found.unionByName(O.checkpointed(_semi(lengths.repartition(width, *on).alias("l"), whole.repartition(width, *on).alias("r"), on)))


def _semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Paths of ``l`` close to a ``k_path`` of ``r`` with the same keys, or their middles to a ``k_middle`` with what edits are left."""
    if "k_middle" in right.columns:
        a, b = F.col("l.middle"), F.col("r.k_middle")
        most = _max_edits(F.greatest(F.length("l.path"), F.col("l.rest") + F.length(b))) - F.col("l.spent")
        cond = (F.abs(F.length(a) - F.length(b)) <= most) & (_edits(a, b, F.greatest(most, F.lit(0))) >= 0)
    else:
        cond = _close(F.col("l.path"), F.col("r.k_path"))
    for c in on:
        cond = (F.col(f"l.{c}") == F.col(f"r.{c}")) & cond
    return left.join(right.hint("merge"), cond, "left_semi").select("host", "path").distinct()


def _close(a: Column, b: Column) -> Column:
    """Similarity above 0.9, as a bound on the edits; the banded distance stops beyond the bound."""
    most = _max_edits(F.greatest(F.length(a), F.length(b)))
    out = F
    for step in _EDIT_STEPS:
        out = out.when(most <= step, F.levenshtein(a, b, step).between(F.lit(0), most))
    return (F.abs(F.length(a) - F.length(b)) <= most) & out.otherwise(F.levenshtein(a, b) <= most)


def with_task_flag(urls: DataFrame, tasks: DataFrame, url: str = "url", task_url: str = "base_url") -> DataFrame:
    """Does a task exist for the url: the same text, the same host and path, or a path above 0.9.

    Exact steps, each only for what the one before left open: equal paths, one
    edit of short paths (shared texts, no pairs), the edits of longer ones
    (beginnings that many known paths share, rare blocks for the other known
    paths). All work on distinct paths; a host with a third of the tasks is
    split by key. What several steps read is checkpointed, so that no plan
    holds another many times. No side is ever broadcast: paths are exploded
    into many keys, which Spark takes to be as few as the rows of the table
    that they are made from.
    """
    known = O.stored(_paths(tasks, task_url))
    flagged = known.withColumn("_same", F.lit(True))
    probe = O.stored(matching(_paths(urls, url), flagged, ["host", "path"], "left"))
    same, rest = probe.filter("_same").select("host", "path"), probe.filter("_same is null").select("host", "path")
    found = O.checkpointed(_by_one_edit(rest, known))
    far, long = rest.filter(F.length("path") >= _LONG), known.filter(F.length("path") >= _LONG)
    members = O.stored(_with_common_head(long))
    headed, others = members.count(), long.count()
    if headed:
        close = _by_heads(far, members, headed)
        found = found.unionByName(close)
        if headed < others:
            far, long = (matching(x, y.select("host", "path"), ["host", "path"], "left_anti") for x, y in ((far, close), (long, members)))
    if headed < others:
        found = found.unionByName(_by_rare_grams(O.checkpointed(far), long))
    # a url without a path is known by its text only
    text = lambda c: F.when(F.col("path") == "", F.col(c)).otherwise("")
    parted = lambda df, c: df.withColumn("host", U.netloc(c)).withColumn("path", U.bare_path(c)).withColumn("_text", text(c))
    bare = parted(tasks.select(task_url), task_url).filter("path = ''").select("host", "path", "_text")
    flags = found.withColumn("_text", F.lit("")).unionByName(bare).distinct().unionByName(
        same.withColumn("_text", F.lit(""))).withColumn("_known", F.lit(True))
    out = matching(parted(urls, url), flags, ["host", "path", "_text"], "left")
    return out.withColumn("task_exists", F.coalesce("_known", F.lit(False))).select(*urls.columns, "task_exists")


# ------------------------------------------------------------ status tables

def with_url_status(urls: DataFrame, status: DataFrame, url: str = "url") -> DataFrame:
    """reachability and validity from a table ``(url, status, content_type)``; unknown urls are not valid."""
    s = status.select(F.col("url").alias("_u"), "status", "content_type")
    out = urls.join(s, F.col(url) == F.col("_u"), "left").drop("_u")
    kind = F.lower(F.coalesce("content_type", F.lit(""))).rlike("|".join(IMAGE_CONTENT_TYPES))
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    return (out.withColumn("reachable", F.coalesce(F.col("status") < REACHABLE_BELOW, F.lit(False)))
            .withColumn("valid_url", ok).withColumn("valid_image", ok & kind))


def with_thresholds(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Warning and critical limits of each metric, 0.0 when there are none."""
    t = thresholds.select("name", F.col("warning"), F.col("critical"))
    rows = samples.join(t, "name", "left")
    return rows.withColumn("warning", F.coalesce("warning", F.lit(0.0))).withColumn(
        "critical", F.coalesce("critical", F.lit(0.0)))


# -------------------------------------------------------------- progress

def latest_progress(progress: DataFrame, order: list[str] = ("ts", "seq")) -> DataFrame:
    return keep_last(progress, ["url"], list(order))


def overlay_progress(images: DataFrame, latest: DataFrame) -> DataFrame:
    """Images with the latest progress of their url; its status wins when there is one."""
    p = latest.select("url", "downloaded", "total", "speed", F.col("status").alias("_status"))
    out = images.join(p, "url", "left")
    return out.withColumn("status", F.coalesce("_status", "status")).drop("_status")


def task_images(tasks: DataFrame, task: str = "task_id") -> DataFrame:
    """Images of the task itself, then those of its pages, one row each in order."""
    both = F.concat(F.coalesce("images", F.array()), F.coalesce(F.flatten("pages.images"), F.array()))
    return tasks.select(task, F.posexplode(both).alias("pos", "image")).select(task, "pos", "image.*")
