"""Secret scans with an inverted index of trigrams, in DataFrame functions only.

From the tree of each rule's regex follows which trigrams any match must hold:
a disjunction of clauses, each a set of trigrams (letters in lower case, so that
both cases share postings). The index holds a posting for each text and each
trigram that some rule's clause names; no other trigram can ever be asked for.
A clause's postings are intersected per text in one grouped bit set, and the
texts that are left are joined to the table and verified by the regex
itself. A rule one of whose clauses is empty has no mandatory trigram: it scans
all texts.

Matches come from ``regexp_extract_all``, the stretches between them from ``split`` at
the same regex. Both are exploded as lengths, and a running sum over a text's
matches gives the places, so that a text with very many matches costs a sort.

Texts are known by id and SHA-256. The join with the candidates and the running
sum are spread by that pair; repeated rows of one id and text share it, and
Spark splits such a join.

Edge cases: a null text is empty; empty texts have no spans; texts are searched
whole, whatever their length; rows that repeat an id keep their own spans; null
ids are kept; an empty table gives no rows; other columns are not read. Spans
of one start come in the order of the rules.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.columns import computed
from .storage import stored

#: Strings of one stretch of a pattern that are followed apart, and trigrams of a clause; what is beyond says less but nothing wrong.
STRINGS, CLAUSE = 64, 62

Clauses = list[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost first, whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def any_case(words: str) -> str:
    """A pattern of ASCII letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


# The base rules. A longest run of one class has its least length in the pattern, as nothing shorter could match in it.
BASE = (
    Rule("assign", rf"""({any_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Public formats of keys and tokens, by their prefixes.
MORE = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


# ------------------------------------------------------------- trigram queries

def _strings(op, arg) -> set[str] | None:
    """All strings that a part of a pattern can match, in lower case; None if they are many."""
    if op is C.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}
    if op is C.IN and all(o is C.LITERAL for o, _ in arg):
        found = set().union(*[_strings(*x) for x in arg])
    elif op is C.SUBPATTERN:
        found = _whole(arg[3])
    elif op is C.BRANCH:
        parts = [_whole(x) for x in arg[1]]
        found = None if None in parts else set().union(*parts)
    elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 3:
        one = _whole(arg[2])
        found = None if one is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(one, repeat=n)}
    else:
        found = None
    return found if found is not None and len(found) <= STRINGS else None


def _whole(parts) -> set[str] | None:
    found = {""}
    for part in parts:
        more = _strings(*part)
        if more is None or len(found) * len(more) > STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _least(clauses: Clauses) -> Clauses:
    """Without clauses that hold only where a smaller one does."""
    return [x for x in dict.fromkeys(clauses) if not any(y < x for y in clauses)]


def _grams(strings: set[str]) -> Clauses:
    return _least([frozenset(list(dict.fromkeys(s[i:i + 3] for i in range(len(s) - 2)))[:CLAUSE]) for s in sorted(strings)])


def _both(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > STRINGS:
        return min(a, b, key=len)
    return _least([x | y if len(x | y) <= CLAUSE else max(x, y, key=len) for x in a for y in b])


def _clauses(parts) -> Clauses:
    """What the matches of a sequence of parts must hold."""
    found: Clauses = [frozenset()]
    held = {""}
    for op, arg in parts:
        more = _strings(op, arg)
        if more is not None and len(held) * len(more) <= STRINGS:
            held = {a + b for a in held for b in more}
            continue
        found, held = _both(found, _grams(held)), {""}
        if more is not None:
            held = more
        elif op is C.SUBPATTERN:
            found = _both(found, _clauses(arg[3]))
        elif op is C.BRANCH:
            found = _both(found, _least(list(itertools.chain(*map(_clauses, arg[1])))))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            found = _both(found, _clauses(arg[2]))
    return _both(found, _grams(held))


def trigram_query(pattern: str) -> Clauses:
    """Clauses of trigrams: every text that the pattern matches holds all trigrams of one; an empty clause holds for any text."""
    return _clauses(_parser.parse(pattern))


# --------------------------------------------------------------- index and scan

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: a row of ``trigram``, ``id`` and ``digest`` for every text that holds it."""
    low = computed(texts, low=F.lower("text"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    return low.select(F.explode(held).alias("trigram"), "id", "digest")


def candidates(index: DataFrame, queries: dict[int, Clauses]) -> DataFrame:
    """``id``, ``digest`` and ``rules``: the numbers of the rules of whose clauses one holds for the text."""
    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [f"({rule}, {k}, {quoted(t)}, {1 << b}L, {(1 << len(clause)) - 1}L)" for rule, clauses in queries.items()
            for k, clause in enumerate(clauses) for b, t in enumerate(sorted(clause))]
    wanted = index.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(rule, clause, trigram, bit, whole)")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("id", "digest", "rule", "clause").agg(
        F.bit_or("bit").alias("bits"), F.first("whole").alias("whole")).where("bits = whole")
    return met.groupBy("id", "digest").agg(F.collect_set("rule").alias("rules"))


def _same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    b = b.withColumnsRenamed({"id": "__id", "digest": "__digest"})
    return a.join(b, a["id"].eqNullSafe(b["__id"]) & (a["digest"] == b["__digest"]), how).drop("__id", "__digest")


def _lengths(rule: Rule, text: Column) -> Column:
    """For every match, and for the rest of the text: characters before it, of it, and of its group."""
    pattern = F.lit(rule.pattern)
    def sizes(group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), lambda x: F.length(x))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    return F.arrays_zip(gaps.alias("gap"), sizes(0).alias("size"), (sizes(rule.group) if rule.group else F.array()).alias("own"))


def _matches(texts: DataFrame, rule: int, spec: Rule) -> DataFrame:
    rows = texts.where(F.col("text").rlike(spec.pattern))
    return rows.select("id", "digest", F.lit(rule).alias("rule"), F.posexplode(_lengths(spec, F.col("text")))).select(
        "id", "digest", "rule", "pos", "col.*")


def spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All secrets of every text: ``id_col`` and ``spans`` (array of ``start``, ``rule``, ``kind``, ``end``; code points, end exclusive).

    Spans are sorted by start and then by the place of their rule.
    """
    texts = _keyed(docs, id_col, text_col)
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    found = [_matches(texts, k, rules[k]) for k in queries if k not in indexed]
    if indexed:
        index = postings(texts, sorted(set().union(*itertools.chain(*indexed.values()))))
        hits = stored(_same(texts, candidates(index, indexed), "inner"), "secret-candidates")
        found += [_matches(hits.where(F.array_contains("rules", k)), k, rules[k]) for k in indexed]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows.dropDuplicates(["id", "digest", "rule", "pos"])  # repeated rows
    before = Window.partitionBy("id", "digest", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.coalesce("size", F.lit(0))).over(before)
    rows = rows.select("*", end.alias("end")).where("size is not null")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    rows = rows.where(F.coalesce("own", "size") >= least)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rule", kind.alias("kind"), "end")
    by_text = rows.groupBy("id", "digest").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = _same(texts.drop("text"), by_text, "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast(by_text.schema["spans"].dataType)).alias("spans"))
