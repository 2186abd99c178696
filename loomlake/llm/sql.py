"""DuckDB SQL with the same rows as the queries, where SQL can say it."""

from __future__ import annotations

from .licenses import TEMPLATES, THRESHOLD, WRAP
from .secrets import ACCESS, ACCOUNT, ASSIGN, ASSIGN_VALUE, ENDPOINT, HEX, SCOPE, WEAK_VALUE


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(pattern: str) -> str:
    p = quoted(pattern)
    return f"string_split_regex(t, {p}) AS pieces, regexp_extract_all(t, {p}, 0) AS hits"


def _spans(kind: int, pattern: str, group: bool) -> str:
    value = f"length(regexp_extract(hits[i], {quoted(pattern)}, 2))" if group else "length(hits[i])"
    return f"""SELECT rid, {kind} AS kind, a AS s, a + length(hits[i]) AS e, {value} AS v FROM (
  SELECT *, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT rid, {_hits(pattern)} FROM d)))"""


_NAME = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' WHEN 3 THEN 'weak_account' WHEN 4 THEN 'weak_secret' ELSE 'endpoint' END || ':' || s || ':' || e"

ORACLES = {
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
every AS ({_spans(0, ASSIGN, True)}
 UNION ALL {_spans(1, ACCESS, False)}
 UNION ALL {_spans(2, HEX, False)}
 UNION ALL {_spans(3, ACCOUNT, True)}
 UNION ALL {_spans(5, ENDPOINT, False)}),
parts AS (SELECT rid, CASE WHEN kind = 0 AND v < {ASSIGN_VALUE} THEN 4 ELSE kind END AS kind, s, e FROM every WHERE kind <> 0 OR v >= {WEAK_VALUE}),
near AS (SELECT w.rid, w.kind, w.s, w.e,
    EXISTS (SELECT 1 FROM parts p WHERE p.rid = w.rid AND p.kind IN (1, 3) AND abs(p.s - w.s) <= {SCOPE}) AS id,
    EXISTS (SELECT 1 FROM parts p WHERE p.rid = w.rid AND p.kind IN (0, 2, 4) AND abs(p.s - w.s) <= {SCOPE}) AS secret
  FROM parts w WHERE kind >= 3),
kept AS (SELECT rid, kind, s, e FROM parts WHERE kind < 3
  UNION ALL SELECT rid, kind, s, e FROM near WHERE CASE kind WHEN 3 THEN secret WHEN 4 THEN id ELSE id AND secret END),
sums AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({_NAME}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({_NAME}, ',' ORDER BY s, kind) AS spans
  FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (rid)""",
}

ORACLES["op4_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i])) AS BIGINT) AS score
  FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

_TEMPLATES = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in TEMPLATES.items())
_WORDS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
_BIGRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

ORACLES["op1_license_scan"] = f"""
WITH t AS (SELECT license_id, {_BIGRAMS} AS b FROM (SELECT license_id, {_WORDS.format('body')} AS w FROM (VALUES {_TEMPLATES}) v(license_id, body))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
l AS (SELECT *, list_filter(string_split_regex(x, '\r?\n'), lambda v: regexp_matches(lower(v), '[a-z0-9]')) AS lines FROM d),
s AS (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l),
n AS (SELECT rid, doc_id, array_to_string(lines[i:i + n - 1], ' ') AS unit FROM (SELECT *, unnest(range(1, least({WRAP}, len(lines) - i + 1) + 1)) AS n FROM s)),
u AS (SELECT DISTINCT rid, doc_id, w FROM (SELECT rid, doc_id, {_WORDS.format('unit')} AS w FROM (SELECT * FROM n UNION ALL SELECT rid, doc_id, unnest(list_concat(string_split_regex(x, '\r?\n[ \t]*\r?\n'), [x])) AS unit FROM d))),
g AS (SELECT rid, doc_id, {_BIGRAMS} AS b FROM u WHERE len(w) > 1 AND len(list_distinct(w)) <= 400),
m AS (SELECT rid, doc_id, license_id, 2.0 * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice FROM g, t WHERE len(g.b) BETWEEN len(t.b) * 0.6 AND len(t.b) * 1.6)
SELECT doc_id, license_id, max(CAST(dice AS DOUBLE)) AS dice, count(*) AS n_units FROM m WHERE dice >= {THRESHOLD} GROUP BY rid, doc_id, license_id"""

ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, a.n AS ni, b.n AS nj, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM p WHERE 100 * c >= 80 * (ni + nj - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.doc_id)
SELECT doc_id, len(any_value(s)) AS n_shingles, min(root) AS component_id FROM r JOIN s USING (doc_id) GROUP BY doc_id"""
