"""Pattern scan against Python's regexes, and its cost on texts with very many matches."""

import random
import re
import time

from crawlwright.operators import scan

PIECES = ["os.system('x')", "eval (1)", "a", "\n", " ", "\n\n", "password = \"verysecret1\"", "SELECT a + b +", "é\U0001f600", "../", "\r\n", "eval", "\n(", "exec\n("]


def brute(text):
    out = []
    for k, (pattern, _, level) in enumerate(p for group in scan.PATTERNS.values() for p in group):
        for m in re.finditer(pattern, text or "", re.I | re.M):
            line = text.count("\n", 0, m.start()) + 1
            out.append((k, line, text.split("\n")[line - 1].strip(), level))
    return sorted(out)


def test_places(spark):
    rng = random.Random(3)
    texts = [None, "", "nothing", "eval(", "\n\neval(", "eval(\n", "eval(eval(\neval("] + [
        "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    rows = [(None if k == 5 else f"f{k // 2}", t) for k, t in enumerate(texts)] * 2  # repeated paths and rows
    got = scan.scan_texts(spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, stream int")).collect()

    def keyed(found):
        return sorted(((p or "", *hit) for p, hit in found))
    assert keyed((r["path"], (r["pattern_no"], r["line_number"], r["code_snippet"], r["level"])) for r in got) == keyed(
        (p, hit) for p, t in rows for hit in brute(t))
    assert scan.scan_texts(spark.createDataFrame([], "path string, text string")).count() == 0


def test_many_matches(spark):
    """Twice the matches in one text take about twice as long."""
    def seconds(n):
        df = spark.createDataFrame([("f", "x = eval(y); exec(z)\n" * n)], "path string, text string").cache()
        df.count()
        best = []
        for _ in range(3):
            start = time.perf_counter()
            assert scan.scan_texts(df).agg({"line_number": "max"}).first()[0] == n
            best.append(time.perf_counter() - start)
        return min(best)
    seconds(2_000)
    assert seconds(40_000) < 2.5 * seconds(20_000)
