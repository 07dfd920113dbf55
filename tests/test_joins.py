"""Duplicate tasks against brute force; validation reasons."""

import random

from pyspark.sql import functions as F

from crawlwright.operators import joins, planning, stats


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def similar(a, b):
    ha, pa = a.split("/", 3)[2], a.split("/", 3)[3].strip("/")
    hb, pb = b.split("/", 3)[2], b.split("/", 3)[3].strip("/")
    if a == b:
        return True
    if ha != hb or not pa or not pb:
        return False
    longer = max(len(pa), len(pb))
    return (longer - distance(pa, pb)) / longer > 0.9


def mutate(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + "z" + text[i:], text[:i] + text[i + 1:], text[:i] + "q" + text[i + 1:]])
    return text


def test_similar_tasks_match_brute_force(spark):
    rng = random.Random(3)
    known, urls = [], ["http://h1/", "http://h1/abcdefghiX"]
    for n in (5, 10, 11, 15, 20, 21, 25, 30, 31, 45, 60, 101, 130, 240):
        for _ in range(6):
            path = "".join(rng.choice("abcde/12") for _ in range(n)).strip("/") or "a"
            host = rng.choice(["h1", "h2"])
            known.append(f"http://{host}/{path}")
            for edits in {0, 1, 2, max(0, (n - 1) // 10), n // 10, n // 10 + 1}:
                urls.append(f"http://{rng.choice([host, host, 'h3'])}/{mutate(rng, path, edits) or 'a'}")
    known += ["http://h1/", "http://h1/abcdefghij"]
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    k = spark.createDataFrame([(x,) for x in known], "base_url string")
    got = {r["url"]: r["task_exists"] for r in joins.with_task_flag(u, k).collect()}
    want = {x: any(similar(x, y) for y in known) for x in urls}
    assert got == want
    assert not got["http://h1/abcdefghiX"] and got["http://h1/"]


def test_paths_with_common_heads_match_brute_force(spark, monkeypatch):
    """Edits on both sides of the cut, moved across it, and more of them in the number than its shared texts allow."""
    monkeypatch.setattr(joins, "_COMMON_HEAD", 3)
    rng = random.Random(5)
    known = [f"http://h1/gallery/{name}-collection-{rng.randrange(10 ** rng.choice([2, 6, 7]))}{end}"
             for name in ("small-ring", "red-widget", "blé-noir", "2-red") for end in (".html", "", ".a-long-ending-of-it") for _ in range(8)]
    urls = [f"http://h1/{mutate(rng, x[10:], n)}" for x in known for n in range(7)]
    urls += [x.replace("ring", "rod") for x in urls] + [x.replace("-collection-", "-collection-9999") for x in known] + ["http://h1/gallery/small-ring-collection"]
    urls += [f"http://h1/gallery/small-ring-collection-{n}.html" for n in ("", "9", "7777777", "987654321")] + [known[0].replace("h1", "h2")]
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    k = spark.createDataFrame([(x,) for x in known], "base_url string")
    got = {r["url"]: r["task_exists"] for r in joins.with_task_flag(u, k).collect()}
    assert got == {x: any(similar(x, y) for y in known) for x in urls}
    assert not joins._with_common_head(joins._paths(k, "base_url")).isEmpty() and 0 < sum(got.values()) < len(got)


def test_a_path_is_compared_with_few_paths_of_a_common_head(spark, monkeypatch):
    """The plan reads each side a few times, and a near head alone makes no pair of paths."""
    monkeypatch.setattr(joins, "_COMMON_HEAD", 3)
    k = spark.createDataFrame([(f"http://h/gallery/small-ring-collection-{100000 + i * 11}.html",) for i in range(300)], "base_url string")
    u = spark.createDataFrame([(f"http://h/gallery/small-rod-collection-{560000 + i * 7}.html",) for i in range(300)], "url string")
    compared = []
    monkeypatch.setattr(joins, "_semi", lambda left, right, on, semi=joins._semi: compared.append(
        left.join(right, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]).count()) or semi(left, right, on))
    out = joins.with_task_flag(u, k)
    assert out.filter("task_exists").count() == 0 and sum(compared) < 300 * 300 / 10
    assert out._jdf.queryExecution().analyzed().toString().count("Generate") <= 8


def test_heads_and_endings_that_repeat_match_brute_force(spark, monkeypatch):
    """Three letters only, so that best cuts cross, endings hold the head's end, and classes are few or too many to be told apart."""
    monkeypatch.setattr(joins, "_COMMON_HEAD", 3)
    rng = random.Random(11)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    known, urls = [], []
    for n in (17, 20, 28, 40):
        for _ in range(4):
            head, ends = some("ab1", n - 1) + "a", ["", "ba", some("ab", 4)]
            paths = [head + some("12", rng.choice([1, 2, 3, 7])) + rng.choice(ends) for _ in range(14)]
            known += [f"http://h/{x}" for x in paths]
            urls += [f"http://h/{mutate(rng, x, e)}" for x in paths[:7] for e in (0, 1, 2, n // 10, n // 10 + 1, n // 10 + 2)]
            urls += [f"http://h/{head}{end}" for end in ends]
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    k = spark.createDataFrame([(x,) for x in known], "base_url string")
    want = {x: any(similar(x, y) for y in known) for x in urls}
    for classes in (1000, 2):
        monkeypatch.setattr(joins, "_CLASSES_MAX", classes)
        assert {r["url"]: r["task_exists"] for r in joins.with_task_flag(u, k).collect()} == want
    assert 0 < sum(want.values()) < len(want)


def test_numbers_that_differ_at_their_end_form_no_pairs(spark, monkeypatch):
    """A key a path finds them; known paths that all have common heads are not looked up by their blocks, and long ones make no one-edit keys."""
    monkeypatch.setattr(joins, "_COMMON_HEAD", 3)
    k = spark.createDataFrame([(f"http://h/gallery/small-ring-collection-{i}0000.html",) for i in range(1000, 1100)], "base_url string")
    u = spark.createDataFrame([(f"http://h/gallery/small-ring-collection-{i}7177.html",) for i in (*range(1000, 1100), *range(9900, 10000))], "url string")
    semi, keys, compared = joins._semi, joins._one_edit_keys, []
    monkeypatch.setattr(joins, "_semi", lambda left, right, on: compared.append(left.select("path").distinct().count()) or semi(left, right, on))
    monkeypatch.setattr(joins, "_by_rare_grams", None)
    monkeypatch.setattr(joins, "_one_edit_keys", lambda *a: keys(*a).withColumn("key", F.when(F.length("path") > 20, F.raise_error(F.lit("long"))).otherwise(F.col("key"))))
    assert joins.with_task_flag(u, k).filter("task_exists").count() == 100 and sum(compared) <= 2 * 100


def test_nothing_is_broadcast(spark):
    """Paths make many keys each, so that their joins are far larger than Spark takes them to be."""
    u, k = spark.createDataFrame([("http://h/a",)], "url string"), spark.createDataFrame([("http://h/b",)], "base_url string")
    dirs = spark.createDataFrame([("a",)], "directory_name string")
    status = spark.createDataFrame([("http://h/a", 200, True)], "url string, status int, has_images boolean")
    for df in (joins.with_task_flag(u, k), planning.validate_tasks(u, k, dirs, status)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_validation_reasons(spark):
    u = spark.createDataFrame([(x,) for x in ("nope", "http://a/dir1.html", "http://a/task", "http://a/down", "http://a/plain", "http://a/good")], "url string")
    tasks = spark.createDataFrame([("http://a/task",)], "base_url string")
    dirs = spark.createDataFrame([("dir1",)], "directory_name string")
    status = spark.createDataFrame([("http://a/plain", 200, False), ("http://a/good", 200, True), ("http://a/dir1.html", 200, True)],
                                   "url string, status int, has_images boolean")
    got = {r["url"]: (r["is_valid"], r["reason"]) for r in planning.validate_tasks(u, tasks, dirs, status).collect()}
    R = planning.REASONS
    assert got == {"nope": (False, R["format"]), "http://a/dir1.html": (False, R["skipped"]), "http://a/task": (False, R["skipped"]),
                   "http://a/down": (False, R["dead"]), "http://a/plain": (True, R["no_images"]), "http://a/good": (True, "")}


def _leaves(spark, operator):
    frames = [spark.createDataFrame(*x) for x in (
        ([("http://h/a",)], "url string"), ([("http://h/b",)], "base_url string"), ([("a",)], "directory_name string"),
        ([("http://h/a", 200, True)], "url string, status int, has_images boolean"))]
    return operator(planning.validate_tasks(*frames))._jdf.queryExecution().analyzed().collectLeaves().size()


def test_the_plan_of_statistics_reads_its_tables_a_few_times(spark):
    assert _leaves(spark, stats.validation_statistics) <= 15


def test_the_plan_of_previews_reads_its_tables_a_few_times(spark):
    assert _leaves(spark, planning.preview_tasks) <= 15
