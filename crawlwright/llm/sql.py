"""The SQL that must give the same rows, for the queries that SQL can state."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, n, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' '))) AS g
  FROM (SELECT *, least(len(w), 13) AS n FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM bw)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM places),
hits AS (SELECT DISTINCT doc_id, item, n, i FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, p.y FROM reach r JOIN pairs p ON r.other = p.x),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), t, chr(10)), '' ORDER BY turn, role, t) AS said,
  coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '') AS loss,
  sum(24 + length(role) + length(t) + len(regexp_extract_all(t, '<\\*(/?s>|</?SYS>>|\|\w+\|>)'))
    + len(regexp_extract_all(t, '\[\\*/?INST\]'))) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars FROM s"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT place, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
t AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM c),
p AS (SELECT place, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT place, unnest(w) AS term FROM c) GROUP BY place, term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, t
  WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT item_id, doc_id, place, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT)
  AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN c USING (place), t GROUP BY item_id, doc_id, place),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""


def secrets(base, more) -> str:
    """Spans of every rule over whole texts, by what stands between the matches."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"
    rules = " UNION ALL ".join(
        f"""SELECT doc_id, place, {k} AS rule, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS gap,
  regexp_extract_all(t, {quoted(r.pattern)}, 0) AS hit, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS own
FROM d WHERE regexp_matches(t, {quoted(r.pattern)})""" for k, r in enumerate((*base, *more)))
    kinds = ", ".join(quoted(r.kind) for r in base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    text = "kind || ':' || (ends - size) || ':' || ends"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS place FROM documents), m AS ({rules}),
x AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM m),
s AS (SELECT place, rule, kind, least, length(hit[i]) AS size, length(own[i]) AS own_size,
  CAST(sum(length(gap[i]) + length(hit[i])) OVER (PARTITION BY place, rule ORDER BY i) AS BIGINT) AS ends FROM x),
g AS (SELECT place, {counts}, string_agg({text}, ',' ORDER BY ends - size, rule) FILTER (kind IN ({kinds})) AS base,
  string_agg({text}, ',' ORDER BY ends - size, rule) AS spans FROM s WHERE own_size >= least GROUP BY place)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (place)"""
