"""DuckDB SQL of the training-data queries that SQL can express.

``op6``'s states canonical links and refreshes with the attributes in their usual order; the operator itself
reads any order.  ``op4``'s, ``op8``'s and ``op9``'s own methods, and the fingerprints, forests and files of the others, have no SQL.
"""

MIX = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src),
o AS (SELECT *, row_number() OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST) AS r FROM w),
p AS (SELECT r, cap, weight, CAST(sum(cap) OVER (ORDER BY r) - cap AS DOUBLE) AS cap_before, CAST(sum(weight) OVER () - sum(weight) OVER (ORDER BY r) + weight AS DOUBLE) AS weight_left,
    CAST(sum(source_size) OVER () AS DOUBLE) * 15e-1 AS budget FROM o),
l AS (SELECT min_by((budget - cap_before) / weight_left, r) AS level FROM p WHERE (budget - cap_before) / weight_left * weight < cap),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), weight * level) END AS target FROM w CROSS JOIN l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 5e-1) / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
d AS (SELECT s.doc_id, s.size, b.source_size, b.target, b.whole, CAST(floor(b.target + 5e-1) AS BIGINT) - b.whole * b.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM d
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, pos, pos + least(len(w), 13) - 1), ' ') AS text FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS pos FROM i WHERE len(w) > 0) AS x),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT k, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS text FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d CROSS JOIN (SELECT DISTINCT size FROM win) AS z WHERE len(w) >= size) AS x),
h AS (SELECT DISTINCT g.k, g.pos, g.size, win.item_id FROM g JOIN win ON win.size = g.size AND win.text = g.text),
n AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(pos, pos + size)) AS p FROM h) AS x GROUP BY k),
m AS (SELECT k, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
    coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated FROM d LEFT JOIN n ON n.k = d.k LEFT JOIN m ON m.k = d.k
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULES = (("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "com", "/en/"), ("block", "org", "/es/"))
_FITS = [(v, h + p, f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')") for v, h, p in _RULES]


def _decided(source: str) -> str:
    parts = rf"translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), {_AZ}) AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path"
    rule = " ".join(f"WHEN {f} THEN '{r}'" for _, r, f in _FITS)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for v, _, f in _FITS)
    return f"SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS decision FROM (SELECT *, {parts} FROM {source}) AS x"


URLS = rf"""
WITH RECURSIVE l AS (SELECT regexp_replace(url, '#.*', '') AS a, regexp_replace(coalesce(nullif(regexp_extract(html, '(?i)<link[^>]*rel=.?canonical[^>]*href=["'']?([^"''> ]+)', 1), ''), regexp_extract(html, '(?i)http-equiv=.?refresh[^>]*url=([^"''> ]+)', 1)), '#.*', '') AS b FROM pages WHERE url LIKE '%://%'),
e AS (SELECT a, b FROM l WHERE b LIKE '%://%' UNION SELECT b, a FROM l WHERE b LIKE '%://%'),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
known AS ({_decided("(SELECT DISTINCT a AS url FROM e)")}),
comp AS (SELECT r.a, bool_or(k.decision = 'block') AND NOT bool_or(k.decision = 'allow') AS blocked FROM reach r JOIN known k ON k.url = r.b WHERE k.decision IS NOT NULL GROUP BY r.a),
p AS ({_decided("pages")})
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.decision, CASE WHEN c.blocked THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN comp c ON c.a = regexp_replace(p.url, '#.*', '')
"""

COPIES = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k
"""

# Every document walks through all 120 orders on its own.
AUDIT = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT part, concat(CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
    FROM w LEFT JOIN labels l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT part, fails, good, toxic, filter_order, CASE WHEN contains(fails, filter_order[1]) THEN 1 WHEN contains(fails, filter_order[2]) THEN 2 WHEN contains(fails, filter_order[3]) THEN 3
    WHEN contains(fails, filter_order[4]) THEN 4 WHEN contains(fails, filter_order[5]) THEN 5 ELSE 6 END AS gone FROM f, o),
s AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, count(*) FILTER (WHERE gone > step) AS kept, count(*) FILTER (WHERE gone = step) AS removed,
    count(*) FILTER (WHERE gone < step AND contains(fails, filter_order[step])) AS redundant, count(*) FILTER (WHERE fails = filter_order[step]) AS unique_fails,
    count(*) FILTER (WHERE gone = step AND good) AS good_lost, count(*) FILTER (WHERE gone = step AND toxic) AS toxic_lost FROM g, range(1, 6) AS r(step) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""
