"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tessera.llm import license_scan as L

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT o.a, o.b FROM o JOIN n AS x ON x.doc_id = o.a JOIN n AS y ON y.doc_id = o.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS node FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.node),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.component_id, n.doc_id) AS component_id FROM n LEFT JOIN c USING (doc_id)"""


def _templates() -> str:
    rows = []
    for t, (label, text) in enumerate([*L.BASE, *L.NOTICES]):
        w = L.template_words(text)
        rows += [f"({t}, '{label}', {len(w) - L.K + 1}, {p}, '{' '.join(w[p : p + L.K])}')" for p in range(len(w) - L.K + 1)]
    return ", ".join(rows)


LICENSE = f"""
WITH t(template, label, whole, place, gram) AS (VALUES {_templates()}),
w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 2)) AS at, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram FROM w WHERE len(w) >= 3),
v AS (SELECT g.doc_id, t.template, t.label, any_value(t.whole) AS whole, g.at - t.place AS diagonal, count(DISTINCT t.place) AS votes FROM g JOIN t USING (gram) GROUP BY g.doc_id, t.template, t.label, g.at - t.place),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {L.SHIFT} THEN 0 ELSE 1 END AS fresh FROM v),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster FROM f),
s AS (SELECT doc_id, template, label, least(1.0e0, sum(votes) / any_value(whole)::DOUBLE) AS share, count(*) FILTER (WHERE votes = whole) AS n_whole, min(diagonal) FILTER (WHERE votes = whole) AS first_whole, max(diagonal) FILTER (WHERE votes = whole) AS last_whole FROM c GROUP BY doc_id, template, label, cluster),
k AS (SELECT *, template < {len(L.BASE)} AS is_base FROM s WHERE CASE WHEN template < {len(L.BASE)} THEN n_whole > 0 ELSE share >= {L.SHARE} END),
d AS (SELECT doc_id, CAST(coalesce(sum(n_whole) FILTER (WHERE is_base), 0) AS BIGINT) AS n_base, min(first_whole) FILTER (WHERE is_base) AS first_word, max(last_whole) FILTER (WHERE is_base) AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (WHERE is_base), []))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(CASE WHEN is_base THEN 1.0e0 ELSE share END) AS score FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(d.n_base, 0) AS n_base, d.first_word, d.last_word, coalesce(d.base_labels, '') AS base_labels, coalesce(d.labels, '') AS labels, coalesce(d.score, 0.0e0) AS score FROM w LEFT JOIN d USING (doc_id)"""

#: Straight from the definition: every step of every order looks at every set of failures.
AUDIT = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
f AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS fails FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM x AS a JOIN x AS b ON b.f <> a.f JOIN x AS c ON c.f NOT IN (a.f, b.f) JOIN x AS d ON d.f NOT IN (a.f, b.f, c.f) JOIN x AS e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
k AS (SELECT filter_order, step, CAST(1 << (ascii(filter_order[step]) - 65) AS INT) AS bit, CAST(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS INT) AS seen FROM (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o)),
s AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN fails & (coalesce(seen, 0) | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(seen, 0) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fails & bit <> 0 AND fails & coalesce(seen, 0) <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN good AND fails & bit <> 0 AND fails & coalesce(seen, 0) = 0 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN toxic AND fails & bit <> 0 AND fails & coalesce(seen, 0) = 0 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost FROM c, k GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM s"""

ORACLE_SQL = {"op9_license_scan": LICENSE, "op10_jaccard_join": JACCARD, "op12_filter_audit": AUDIT}
