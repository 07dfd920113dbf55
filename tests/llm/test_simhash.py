"""SimHash near-duplicates against all pairs."""

import random
import re

import xxhash

from crawlwright.llm import components, queries, simhash

FOLDER = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(items, linked):
    """Smallest member of each item's component."""
    top = {x: x for x in items}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i, x in enumerate(items):
        for y in items[i + 1:]:
            if linked(x, y):
                a, b = find(x), find(y)
                top[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def brute(rows):
    prints = {i: brute_fingerprint(t) for i, t in rows}
    found = groups(sorted(prints), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 3)
    return sorted((i, f"{prints[i]:016x}", found[i]) for i, _ in rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op4_simhash(spark, FOLDER).collect())) == brute(rows)


def test_cases(spark):
    base = " ".join(f"word{i % 37}x{i}" for i in range(400))
    rows = [(5, None), (3, ""), (4, " \t"), (1, "One"), (2, "one"), (9, "a b"), (8, base), (7, base + " end"), (6, base.upper()),
            (8, base), (11, "b\x1cc d"), (12, "é É ü"), (13, "long " * 100_000), (14, "long " * 100_001)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == brute(rows)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in brute(rows) if i == c)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "other words")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(null).collect()) == [(0, 0), (0, 4), (4, 4)]
    assert simhash.deduplicated(null).count() == 3


def test_repeated_ids(spark):
    """A row of an id goes for its own text only; a text of which no copy is kept never goes."""
    rows = [(1, "one text of some words"), (5, "one text of some words"), (5, "quite another thing here"), (5, "quite another thing here"),
            (7, "quite another thing here"), (8, None), (9, ""), (9, "last words")]
    docs = spark.createDataFrame([(i, t, k, "x", "y") for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, place int, id string, digest string")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.place for r in kept.collect()) == [0, 2, 3, 5, 7]


def test_links(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(6):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_links_no_broadcast(spark):
    """The variants, 64 to a fingerprint, are never gathered on the driver, however small the table of fingerprints looks."""
    few = spark.createDataFrame([(1,), (3,)], "fingerprint long")
    plan = simhash.links(few)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, 1000 + i) for i in range(50)]
    noise = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    links = chain + hub + noise + [(3, 3), (9, 8), (9, 8)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(links + [(None, 4)], "a long, b long")).collect()))
    pairs = {frozenset(x) for x in links}
    nodes = sorted({x for p in links for x in p if p[0] != p[1]})
    assert got == groups(nodes, lambda x, y: frozenset((x, y)) in pairs)
