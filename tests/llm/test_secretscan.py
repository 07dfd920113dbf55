"""Secrets against Python's own regex search, rule by rule."""

import hashlib
import random
import re

import pytest

from crawlwright.llm import queries, secretscan

FOLDER = "/root/testdata/sf0.001"
RULES = secretscan.BASE + secretscan.MORE
# The base rules as the contract states them.
CONTRACT = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def ascii_cased(text):
    """The long s and the Kelvin sign are no letters of a rule, whatever Python says."""
    return text.replace("ſ", "ß").replace("K", "ß")


def brute(text):
    text, out = ascii_cased(text or ""), []
    for k, rule in enumerate(RULES):
        pattern, group, least = CONTRACT.get(rule.kind) or (re.compile(rule.pattern), rule.group, rule.least)
        out += [(m.start(), k, rule.kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out)


TEXTS = [
    None, "", "x", "password=abcdef", "PassWord = 'abc.def+/=' tail", "token: short", "password:token: abcdefgh", "api_key=\"k1234567\" apikey:zzzzzz",
    "SECRET=aa secret==bbbbbb", "AKIA" + "A" * 16, "AKIA" + "B" * 15, "xAKIAAKIA" + "C1" * 9 + "d", "f" * 24, "0123456789abcdef" * 3 + "g" + "a" * 23,
    "é\U0001f600 token=ſecret secret=abcdefg\U0001f600", "toKen=abcdefg", "ghp_" + "a" * 36, "gho_" + "a" * 35, "xoxb-1234567890-abc",
    "AIza" + "x" * 35 + "y", "eyJhbGciOi.eyJhbGciOiJ.abcdefgh12", "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----\nabc",
    "token=" + "a" * 300_000, "secret=abcdef " * 3_000, "\n".join("hex " + "%032x" % k for k in range(400)), "passwd\x20\x20:\x20'a-b_c.d=e'",
]


def test_texts(spark):
    rows = [(k // 2 if k % 5 else None, t) for k, t in enumerate(TEXTS)]
    rows += rows[:12]  # repeated rows and ids
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, digest string, spans int, id string")
    got = secretscan.spans(docs)
    assert got.columns == ["doc_id", "spans"]

    def sort(found):
        return sorted(((-1 if i is None else i), s) for i, s in found)
    assert sort((r.doc_id, [tuple(s) for s in r.spans]) for r in got.collect()) == sort((i, brute(t)) for i, t in rows)
    assert secretscan.spans(docs.limit(0)).count() == 0


def test_query(spark):
    want = []
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        found = brute(r.text)

        def joined(kinds):
            return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found if kind in kinds)
        want.append((r.doc_id, *[sum(x[2] == k for x in found) for k in CONTRACT],
                     hashlib.sha256(joined(CONTRACT).encode()).hexdigest(), joined([r.kind for r in RULES])))
    got = queries.op13_secret_scan(spark, FOLDER)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("pattern, clauses", [
    ("abc", ["abc"]), ("abcd", ["abc bcd"]), ("ab", [""]), ("[aA][bB]c+d", [""]), ("abc|xyz", ["abc", "xyz"]), ("abc|x", [""]),
    ("ab?cd", ["abc bcd", "acd"]), ("(foo|bar)[0-9]+baz", ["bar baz", "baz foo"]), ("(abc)*def", ["def"]), ("(abcd)+", ["abc bcd"]),
    ("[0-9a-f]{24,}", [""]), ("a{3}", ["aaa"]), ("abc.def", ["abc def"]), ("(?:abc){2}", ["abc bca cab"]), ("KEY", ["key"]),
    ("abc(|d)", ["abc"]), ("[^a]bcd", ["bcd"]), ("^abc$", ["abc"]),
])
def test_trigram_query(pattern, clauses):
    assert sorted(" ".join(sorted(c)) for c in secretscan.trigram_query(pattern)) == sorted(clauses)


def test_queries_lose_nothing():
    """Whatever a pattern matches holds one of its clauses."""
    rng = random.Random(2)
    pieces = ["ab", "c", "(a|bc)", "[ab]", "c?", "(ab)+", ".", "b{2}", "(abc|cab|)", "[abcdefghij]"]
    for _ in range(400):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randint(2, 7)))
        clauses = secretscan.trigram_query(pattern)
        for _ in range(40):
            text = "".join(rng.choice("abcABC") for _ in range(12))
            if re.search(pattern, text):
                held = {text[i:i + 3].lower() for i in range(10)}
                assert any(c <= held for c in clauses), (pattern, text, clauses)


def test_rules_without_index(spark):
    """Rules that all scan fully, and rules that all go through the index."""
    docs = spark.createDataFrame([(1, "aa bbb 12 abcxabc"), (2, "zz")], "doc_id long, text string")
    for rules in ((secretscan.Rule("digits", "[0-9]+"),), (secretscan.Rule("abc", "abc"),)):
        got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secretscan.spans(docs, rules).collect()}
        assert got == {1: [m.span() for m in re.finditer(rules[0].pattern, "aa bbb 12 abcxabc")], 2: []}


def test_no_python(spark):
    plan = queries.op13_secret_scan(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD", "CartesianProduct", "NestedLoop"))
