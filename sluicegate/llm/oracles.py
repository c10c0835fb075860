"""SQL (DuckDB) for the queries of this subpackage that SQL can express, written from the definitions and not from the operators."""

from __future__ import annotations

_WORDS = r"string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+')"

#: Distinct word 3-grams of each text, all pairs that share one, and the least id that links reach.
NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter({_WORDS}, lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 90 * (na + nb - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = s.doc_id
"""

#: Every document scored for every query, the ten best kept.
TOPK = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
p AS (SELECT doc_id, any_value(dl) AS dl, g, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS g FROM t) GROUP BY doc_id, g),
d AS (SELECT g, count(*) AS df FROM p GROUP BY g), m AS (SELECT count(*) AS n, sum(len(w)) / count(*)::DOUBLE AS mean FROM t),
q AS (SELECT doc_id AS query_id, g FROM p WHERE doc_id % 50 = 0),
s AS (SELECT query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN p USING (g) JOIN d USING (g), m GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""

_RULES = (("example.com", "/en/7", "example.com/en/7", "allow"), ("example.net", "/de/8", "example.net/de/8", "allow"), ("com", "/en/", "com/en/", "block"), ("net", "/de/", "net/de/", "block"), ("org", "/es/", "org/es/", "block"))


def url_filter(rounds: int = 10, damping: float = 0.85) -> str:
    """Rules as a join, and the propagation unrolled round by round."""
    rules = ", ".join(f"('{h}', '{p}', '{r}', '{v}')" for h, p, r, v in _RULES)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = low.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
    link = r"(?i)<a\s[^>]*?href\s*=\s*[\"'']?\s*(?:https?:)?//([^\"''\s>/?#]+)"
    keep = 1 - damping
    steps = [f"k0 AS (SELECT host, {keep} * g AS g, {keep} * b AS b FROM seed)"]
    for i in range(rounds):
        steps.append(f"a{i} AS (SELECT o AS host, {damping} * sum(ft * k.g) AS t, {damping} * sum(fb * k.b) AS d FROM flow JOIN k{i} k ON k.host = flow.i GROUP BY o)")
        steps.append(f"k{i + 1} AS (SELECT coalesce(a.host, s.host) AS host, coalesce(t, 0) + {keep} * coalesce(s.g, 0) AS g, coalesce(d, 0) + {keep} * coalesce(s.b, 0) AS b FROM a{i} a FULL JOIN seed s ON s.host = a.host)")
    return rf"""
WITH rule AS (SELECT * FROM (VALUES {rules}) AS r(rh, rp, rule, rv)),
page AS (SELECT page_id, html, {host} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fit AS (SELECT page.*, (SELECT struct_pack(rule := rule, v := rv) FROM rule WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rule) DESC, rv DESC, rule LIMIT 1) AS f FROM page),
link AS (SELECT host AS src, {low.format(f"unnest(regexp_extract_all(html, '{link}', 1))")} AS dst FROM page),
edge AS (SELECT src, dst, count(*)::DOUBLE AS w FROM link WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
share AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS ft, w / sum(w) OVER (PARTITION BY dst) AS fb FROM edge),
flow AS (SELECT src AS i, dst AS o, ft, 0.0::DOUBLE AS fb FROM share UNION ALL SELECT dst, src, 0, fb FROM share),
raw AS (SELECT host, count(*) FILTER (f.v = 'allow')::DOUBLE AS g, count(*) FILTER (f.v = 'block')::DOUBLE AS b FROM fit GROUP BY host),
seed AS (SELECT host, coalesce(g / nullif(sum(g) OVER (), 0), 0) AS g, coalesce(b / nullif(sum(b) OVER (), 0), 0) AS b FROM raw WHERE g > 0 OR b > 0),
{", ".join(steps)},
bad AS (SELECT host FROM a{rounds - 1} WHERE d > t)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM fit
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": NGRAM_JOIN, "op5_topk_search": TOPK, "op9_url_filter": url_filter()}
