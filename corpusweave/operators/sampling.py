"""Sampling and quota allocation.  Every seeded order is an order by sha256, the same on any engine."""

from corpusweave.plans.sql import Statement as S

STATEMENTS = {
    "smp_largest_remainder": S(
        """WITH w AS (SELECT source AS k, count(*) AS w FROM documents GROUP BY source), f AS (SELECT k, floor(500 * w / CAST(sum(w) OVER () AS DOUBLE)) AS base, 500 * w / CAST(sum(w) OVER () AS DOUBLE) - floor(500 * w / CAST(sum(w) OVER () AS DOUBLE)) AS frac FROM w), r AS (SELECT k, base, row_number() OVER (ORDER BY frac DESC, k DESC) AS n, 500 - sum(base) OVER () AS left_over FROM f)
        SELECT k, CAST(base + CASE WHEN n <= left_over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r"""
    ),
    "smp_stratified_quota": S(
        """WITH r AS (SELECT id, band, grp, row_number() OVER (PARTITION BY band, grp ORDER BY sha2('7:' || CAST(id AS STRING), 256)) AS n, count(*) OVER (PARTITION BY band, grp) AS avail FROM frame), d AS (SELECT band, sum(greatest(30 - avail, 0)) AS deficit FROM (SELECT DISTINCT band, grp, avail FROM r) AS x GROUP BY band),
        s AS (SELECT r.id, r.band, r.grp, r.n, d.deficit, row_number() OVER (PARTITION BY r.band ORDER BY CASE WHEN r.n <= 30 THEN 0 ELSE 1 END, sha2('7:' || CAST(r.id AS STRING), 256)) AS k, sum(CASE WHEN r.n <= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY r.band) AS base FROM r JOIN d ON d.band = r.band)
        SELECT id, band, grp FROM s WHERE n <= 30 OR k <= base + deficit"""
    ),
    "smp_seeded_n": S("""SELECT doc_id FROM documents ORDER BY sha2('42:' || CAST(doc_id AS STRING), 256) LIMIT 100"""),
    "smp_bias_weights": S(
        """WITH g AS (SELECT f.band, f.grp, count(*) AS n, avg(CAST(1 - l.quality AS DOUBLE)) AS r FROM frame f JOIN labels l ON l.doc_id = f.id GROUP BY f.band, f.grp), o AS (SELECT avg(CAST(1 - quality AS DOUBLE)) AS r FROM labels) SELECT band, grp, round(n * (1 + 5e-1 * (g.r / o.r - 1)), 6) AS weight FROM g CROSS JOIN o"""
    ),
    "smp_old_new_split": S(
        """WITH r AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS old, row_number() OVER (PARTITION BY l.doc_id IS NOT NULL ORDER BY sha2('3:' || CAST(d.doc_id AS STRING), 256)) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT doc_id, old FROM r WHERE n <= 200 AND (old AND n <= CAST(floor(25e-2 * 200 + 5e-1) AS BIGINT) OR NOT old AND n <= 200 - CAST(floor(25e-2 * 200 + 5e-1) AS BIGINT))""",
        """WITH r AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS old, row_number() OVER (PARTITION BY l.doc_id IS NOT NULL ORDER BY sha2('3:' || CAST(d.doc_id AS STRING), 256)) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT doc_id, old FROM r WHERE old AND n <= CAST(floor(25e-2 * 200 + 5e-1) AS BIGINT) OR NOT old AND n <= 200 - CAST(floor(25e-2 * 200 + 5e-1) AS BIGINT)""",
    ),
    "smp_flag_priority": S(
        """WITH t AS (SELECT doc_id, CASE WHEN text LIKE '%token = %' THEN 1 WHEN text LIKE '%@%' THEN 2 WHEN text LIKE '%License%' THEN 3 ELSE 4 END AS flag FROM documents), r AS (SELECT doc_id, flag, row_number() OVER (PARTITION BY flag ORDER BY sha2('5:' || CAST(doc_id AS STRING), 256)) AS n FROM t) SELECT doc_id, flag FROM r WHERE n <= 10"""
    ),
    "smp_greedy_cover_rarity": S(
        """WITH t AS (SELECT DISTINCT user_id, event_type || CAST(event_id % 13 AS STRING) AS tag FROM events WHERE value > 80), c AS (SELECT tag, count(*) AS n FROM t GROUP BY tag) SELECT t.user_id, round(sum(1e0 / c.n), 6) AS rarity FROM t JOIN c ON c.tag = t.tag GROUP BY t.user_id"""
    ),
    "smp_month_rowgroup": S(
        """WITH b AS (SELECT id, month, floor(id / 200) AS blk FROM frame), k AS (SELECT month, blk, row_number() OVER (PARTITION BY month ORDER BY sha2(CAST(month AS STRING) || ':' || CAST(CAST(blk AS BIGINT) AS STRING), 256)) AS n FROM (SELECT DISTINCT month, blk FROM b) AS x), p AS (SELECT b.id, b.month, row_number() OVER (PARTITION BY b.month ORDER BY sha2('9:' || CAST(b.id AS STRING), 256)) AS n FROM b JOIN k ON k.month = b.month AND k.blk = b.blk AND k.n = 1)
        SELECT id, month, CASE WHEN n <= 2 THEN 'main' WHEN n % 2 = 1 THEN 'spare1' ELSE 'spare2' END AS part FROM p"""
    ),
    "smp_stride_corpus": S(
        """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i, ceil(sum(n_chars) OVER () / 200000e0) AS stride FROM documents), s AS (SELECT doc_id, n_chars, i, coalesce(sum(n_chars) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r WHERE i % CAST(stride AS BIGINT) = 0) SELECT doc_id FROM s WHERE i = 0 OR used + n_chars <= 200000"""
    ),
    "smp_yield_plan": S(
        """WITH b AS (SELECT band, count(*) AS n, sum(n_chars) AS chars FROM frame GROUP BY band), y AS (SELECT sum(chars) / CAST(sum(n) AS DOUBLE) AS yield_per FROM b) SELECT band, CAST(ceil(100000e0 / (n / CAST(sum(n) OVER () AS DOUBLE)) * 11e-1 / 91e-2 / yield_per) AS BIGINT) AS items FROM b CROSS JOIN y"""
    ),
    "items_first_seen": S("""SELECT source, min_by(doc_id, doc_id) AS first_id, min_by(lang, doc_id) AS lang FROM documents WHERE source <> 'src0' GROUP BY source"""),
    "items_best_row": S("""SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY filled DESC, layer) AS n FROM (SELECT d.doc_id AS k, d.source AS v, 2 AS filled, 1 AS layer FROM documents d UNION ALL SELECT l.doc_id, CAST(l.quality AS STRING), 1 + l.quality * 2, 2 FROM labels l) AS u) AS x WHERE n = 1"""),
    "items_latest_routed": S("""SELECT idc, CASE WHEN value > 100 THEN 'deep' WHEN stage = 'view' THEN 'quick' ELSE 'plain' END AS route, sha2(CAST(idc AS STRING) || '|' || stage || '|' || CAST(seq AS STRING), 256) AS ident FROM (SELECT idc, stage, seq, value, row_number() OVER (PARTITION BY idc ORDER BY seq DESC) AS n FROM cells WHERE status = 'ok') AS x WHERE n = 1"""),
    "items_proportional_sample": S(
        """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, 100 * n / CAST(sum(n) OVER () AS DOUBLE) AS x FROM c), a AS (SELECT lang, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, lang DESC) <= 100 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM q), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha2('1:' || CAST(doc_id AS STRING), 256)) AS n FROM documents)
        SELECT r.doc_id, r.lang FROM r JOIN a ON a.lang = r.lang WHERE r.n <= a.quota"""
    ),
    # the first 50 turns need the first 50 of each source only, which every task cuts before the shuffle
    "items_cluster_rotate": S(
        """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha2('2:' || CAST(doc_id AS STRING), 256)) AS rn FROM documents) AS x WHERE rn <= 50 ORDER BY rn, source LIMIT 50""",
        """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY rn, source) AS k FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha2('2:' || CAST(doc_id AS STRING), 256)) AS rn FROM documents) AS x) AS y WHERE k <= 50""",
    ),
}
