"""DuckDB statements of the queries that SQL can express, over whole tables.

They are written from the contracts, not from the operators: plain joins and aggregates that suit small tables."""

from __future__ import annotations

from . import linededup, rabitq, secretscan, urltree

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_GRAPHIC = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS g FROM k),
sizes AS (SELECT DISTINCT n FROM win),
placed AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT a.doc_id, a.k, a.n, win.item FROM (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM placed) a JOIN win ON a.g = win.g AND a.n = win.n),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN words USING (doc_id)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op2() -> str:
    """Matches are put between two control characters, which gives their places."""
    parts = []
    for k, rule in enumerate(secretscan.RULES):
        pattern = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(rule.kind, rule.pattern)
        value = f"regexp_replace(m, {_quoted('^(?:' + rule.prefix + ')')}, '')" if rule.prefix else "m"
        least = {"hex": 32}.get(rule.kind, rule.least)
        parts.append(f"""
p{k} AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), {_quoted("(?s)(" + pattern.replace("(", "(?:") + ")")}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM documents),
u{k} AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS nth FROM p{k}),
c{k} AS (SELECT doc_id, nth, string_split(x, chr(2))[1] AS m, sum(length(replace(x, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY nth) - length(replace(x, chr(2), '')) AS s FROM u{k}),
m{k} AS (SELECT doc_id, {k} AS kind, '{rule.kind}' AS name, s, s + length(m) AS e FROM c{k} WHERE nth > 1 AND length(m) >= {least} AND length({value}) >= {rule.least_value})""")
    every = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(len(parts)))
    told = "string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind)"
    base = len(secretscan.BASE)
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = {k}), 0) AS n_{r.kind}" for k, r in enumerate(secretscan.BASE))
    names = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secretscan.BASE)
    return f"""WITH {','.join(parts)},
a AS ({every}), g AS (SELECT doc_id, {counts}, {told} FILTER (kind < {base}) AS own, {told} AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""


#: A line goes if it lies in a run of enough words that also stands in an earlier document; shortest runs, forward and backward, cover all such runs.
OP3 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
f AS (SELECT doc_id, x, pos, len(regexp_extract_all(x, {_GRAPHIC})) AS w FROM l),
n AS (SELECT doc_id, x, pos, row_number() OVER o AS i, sum(w) OVER o AS c, sum(w) OVER o - w AS b FROM f WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT doc_id, list(x ORDER BY i) AS xs FROM n GROUP BY doc_id),
r AS (SELECT a.doc_id, a.i AS s, min(z.i) AS e FROM n a JOIN n z ON a.doc_id = z.doc_id AND z.c - a.b >= {linededup.MIN_WORDS} AND z.i >= a.i GROUP BY ALL
 UNION SELECT z.doc_id, max(a.i), z.i FROM n a JOIN n z ON a.doc_id = z.doc_id AND z.c - a.b >= {linededup.MIN_WORDS} AND z.i >= a.i GROUP BY z.doc_id, z.i),
k AS (SELECT doc_id, s, e, array_to_string(xs[s:e], chr(10)) AS key FROM r JOIN t USING (doc_id)),
o AS (SELECT key, min(doc_id) AS owner FROM k GROUP BY key),
g AS (SELECT DISTINCT k.doc_id, unnest(range(s, e + 1)) AS i FROM k JOIN o USING (key) WHERE owner < k.doc_id),
gone AS (SELECT g.doc_id, n.pos FROM g JOIN n ON g.doc_id = n.doc_id AND g.i = n.i),
kept AS (SELECT l.doc_id, count(gone.pos) AS n_deleted, coalesce(string_agg(x, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS rest FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE length(d.text) - length(replace(d.text, chr(10), '')) + 1 END::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
 coalesce(n_deleted > 0 AND trim(replace(rest, chr(10), '')) = '', false) AS emptied, CASE WHEN n_deleted > 0 THEN rest ELSE d.text END AS text
FROM documents d LEFT JOIN kept USING (doc_id)"""

_CLASSES = """
c AS (SELECT a AS id, min(b) AS root FROM (SELECT a, b FROM reach UNION ALL SELECT id, id FROM ids) GROUP BY a)"""

OP8 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / norm) AS e FROM ok WHERE norm > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= {rabitq.COSINE}),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
ids AS (SELECT vec_id AS id FROM embeddings), {_CLASSES.strip()},
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c.root AS component_id, c.id = c.root AS kept FROM c LEFT JOIN n USING (id)"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_GRAPHIC}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
ids AS (SELECT doc_id AS id FROM documents), {_CLASSES.strip()}
SELECT c.id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.root AS component_id FROM c LEFT JOIN n ON n.doc_id = c.id"""

_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{k}}}" for k, (_, h, p) in enumerate(sorted(urltree.RULES, key=lambda r: -len(r[1] + r[2]))))
_ORDERED = sorted(urltree.RULES, key=lambda r: -len(r[1] + r[2]))
URL_BASE = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
p AS (SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h)
SELECT page_id, host, path, CASE {_FITS.format(*(f"'{h}{p}'" for _, h, p in _ORDERED))} END AS rule, CASE {_FITS.format(*(f"'{v}'" for v, _, _ in _ORDERED))} END AS rule_verdict FROM p"""

UNIGRAM = f"""
WITH RECURSIVE crc AS (SELECT i::UBIGINT AS i, i::UBIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS v FROM crc WHERE k = 8),
fold AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: xor(a >> 8, tab.v[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 5 = 1 AS held FROM documents, tab),
t AS (SELECT doc_id, held, unnest(list_append(regexp_extract_all({_LOWER}, {_GRAPHIC}), chr(10))) AS w FROM fold),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w), z AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held AS held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, (SELECT n FROM z)::BIGINT AS train_tokens,
 round(sum(log10((coalesce(c.c, 0) + 0.5) / ((SELECT n FROM z) + 0.5 * ((SELECT v FROM z) + 1)))), 3) AS base_score
FROM t LEFT JOIN c USING (w) GROUP BY doc_id, held"""

SQL = {"op1_decontamination": OP1, "op2_secret_scan": _op2(), "op3_line_dedup": OP3, "op8_near_vectors": OP8, "op9_jaccard_join": OP9, "check_unigram_base": UNIGRAM, "check_url_rules": URL_BASE}
