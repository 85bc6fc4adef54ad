"""Aggregations: one statement for each operator."""

from corpusweave.plans.sql import Statement as S

STATEMENTS = {
    "agg_strata_counts": S("""SELECT band, grp, count(*) AS n FROM frame GROUP BY band, grp"""),
    "agg_coverage": S("""SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS top, max(l_linenumber) - count(*) AS missing, round(count(*) / CAST(max(l_linenumber) AS DOUBLE), 6) AS coverage FROM lineitem GROUP BY l_orderkey"""),
    "agg_group_share": S("""SELECT month, grp, n, round(n / CAST(greatest(sum(n) OVER (PARTITION BY month), 1) AS DOUBLE), 6) AS share FROM (SELECT month, grp, count(*) AS n FROM frame GROUP BY month, grp) AS x"""),
    "agg_conditional_counts": S("""SELECT idc, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS done, count(*) FILTER (WHERE status IN ('fail', 'lost')) AS failed FROM cells GROUP BY idc"""),
    "agg_distinct_keys": S("""SELECT DISTINCT idc, arm, variant FROM cells WHERE status = 'ok' AND stage IN ('click', 'view')"""),
    "agg_sum_quota": S("""SELECT c.c_custkey, count(o.o_orderkey) AS tasks, round(coalesce(sum(o.o_totalprice), 0), 2) AS bytes FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey"""),
    "agg_stage_rates": S(
        """WITH w AS (SELECT status, stage, arm FROM (SELECT status, stage, arm, row_number() OVER (PARTITION BY idc, arm, run, variant, stage ORDER BY seq DESC) AS n FROM cells) AS x WHERE n = 1)
        SELECT stage, arm, count(*) AS total, count(*) FILTER (WHERE status = 'skip') AS skipped, count(*) FILTER (WHERE status = 'ok' OR stage = 'view' AND status = 'warn') AS ok,
        round(count(*) FILTER (WHERE status = 'ok' OR stage = 'view' AND status = 'warn') / CAST(nullif(count(*) FILTER (WHERE status <> 'skip'), 0) AS DOUBLE), 6) AS rate FROM w GROUP BY stage, arm"""
    ),
    "agg_ticket_cluster": S(
        """WITH f AS (SELECT stage, status, idc, seq, row_number() OVER (PARTITION BY stage, status, idc ORDER BY seq) AS k FROM cells WHERE status <> 'ok'), d AS (SELECT stage, status, idc, row_number() OVER (PARTITION BY stage, status ORDER BY seq) AS r FROM f WHERE k = 1)
        SELECT c.stage, c.status, c.n, e.examples, CAST(row_number() OVER (ORDER BY c.n DESC, c.stage, c.status) AS BIGINT) AS ticket FROM (SELECT stage, status, count(*) AS n FROM f GROUP BY stage, status) c
        JOIN (SELECT stage, status, array_join(array_sort(collect_list(lpad(CAST(r AS STRING), 2, '0') || '=' || CAST(idc AS STRING))), ',') AS examples FROM d WHERE r <= 5 GROUP BY stage, status) e ON e.stage = c.stage AND e.status = c.status""",
        """WITH f AS (SELECT stage, status, idc, seq, row_number() OVER (PARTITION BY stage, status, idc ORDER BY seq) AS k FROM cells WHERE status <> 'ok'), d AS (SELECT stage, status, idc, row_number() OVER (PARTITION BY stage, status ORDER BY seq) AS r FROM f WHERE k = 1)
        SELECT c.stage, c.status, c.n, e.examples, CAST(row_number() OVER (ORDER BY c.n DESC, c.stage, c.status) AS BIGINT) AS ticket FROM (SELECT stage, status, count(*) AS n FROM f GROUP BY stage, status) c
        JOIN (SELECT stage, status, array_to_string(list_sort(list(lpad(CAST(r AS VARCHAR), 2, '0') || '=' || CAST(idc AS VARCHAR))), ',') AS examples FROM d WHERE r <= 5 GROUP BY stage, status) e ON e.stage = c.stage AND e.status = c.status""",
    ),
    "agg_rescue": S("""WITH w AS (SELECT idc, max(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) AS tried, max(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS done FROM cells WHERE stage = 'error' GROUP BY idc)
        SELECT count(*) FILTER (WHERE tried = 1) AS attempted, count(*) FILTER (WHERE tried = 1 AND done = 1) AS rescued, round(count(*) FILTER (WHERE tried = 1 AND done = 1) / CAST(nullif(count(*) FILTER (WHERE tried = 1), 0) AS DOUBLE), 6) AS rate FROM w"""),
    "agg_transition_matrix": S(
        """WITH a AS (SELECT idc, max_by(status, seq) AS s FROM cells WHERE run IN ('r0', 'r1') AND stage = 'click' GROUP BY idc), b AS (SELECT idc, max_by(status, seq) AS s FROM cells WHERE run IN ('r2', 'r3') AND stage = 'click' GROUP BY idc)
        SELECT coalesce(a.s, '(absent)') AS a_status, coalesce(b.s, '(absent)') AS b_status, count(*) AS n FROM a FULL OUTER JOIN b ON a.idc = b.idc GROUP BY 1, 2"""
    ),
    "agg_gate_scorecard": S(
        """WITH c AS (SELECT idc, max_by(status, seq) AS s FROM cells WHERE stage = 'click' GROUP BY idc), f AS (SELECT idc, max_by(status, seq) AS s FROM cells WHERE stage = 'view' GROUP BY idc),
        j AS (SELECT c.idc, c.s AS cs, coalesce(f.s, c.s) AS fs FROM c LEFT JOIN f ON f.idc = c.idc)
        SELECT count(*) AS n, count(*) FILTER (WHERE fs = 'ok') AS end_ok, count(*) FILTER (WHERE cs = 'ok' OR fs = 'ok') AS best_ok, round(100e0 * count(*) FILTER (WHERE fs = 'ok') / count(*), 4) AS pct, CAST(ceil(9e-1 * count(*)) AS BIGINT) - count(*) FILTER (WHERE fs = 'ok') AS needed, count(*) FILTER (WHERE cs <> 'ok' AND fs = 'ok') AS lifted, count(*) FILTER (WHERE cs = 'ok' AND fs <> 'ok') AS dropped FROM j"""
    ),
    "agg_population_account": S("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE status = 'skip') AS filtered, count(*) FILTER (WHERE idc < 5) AS bad_id, count(*) FILTER (WHERE status <> 'skip' AND idc >= 5) AS accepted, count(DISTINCT idc) AS uniq, count(*) - count(DISTINCT idc) AS superseded FROM cells WHERE stage = 'click'"""),
    "agg_model_board": S(
        """WITH r AS (SELECT stage, status, value, row_number() OVER (PARTITION BY stage ORDER BY value, seq) AS rn, count(*) OVER (PARTITION BY stage) AS c FROM cells)
        SELECT stage, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status IN ('fail', 'lost')) AS errors, percentile(value, 5e-1) AS median, max(CASE WHEN rn = least(c, CAST(floor(95 * c / 100e0) AS BIGINT) + 1) THEN value END) AS p95, round(sum(value), 2) AS total FROM r GROUP BY stage"""
    ),
    "agg_score_report": S(
        """WITH s AS (SELECT l.doc_id, 40 * l.quality + 50 - 30 * l.toxic + d.n_chars % 11 AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
        SELECT count(*) AS n, round(avg(score), 6) AS mean, percentile(score, 5e-1) AS median, count(*) FILTER (WHERE score >= 90) AS top, count(*) FILTER (WHERE score >= 75 AND score < 90) AS good, count(*) FILTER (WHERE score >= 60 AND score < 75) AS fair, count(*) FILTER (WHERE score < 60) AS poor FROM s"""
    ),
    "agg_penalty_topn": S(
        """WITH e AS (SELECT idc, CASE status WHEN 'warn' THEN 1 WHEN 'fail' THEN 5 WHEN 'lost' THEN 25 ELSE 0 END AS w, row_number() OVER (PARTITION BY idc ORDER BY CASE status WHEN 'warn' THEN 1 WHEN 'fail' THEN 5 WHEN 'lost' THEN 25 ELSE 0 END DESC, seq) AS n FROM cells WHERE status <> 'skip')
        SELECT idc, CAST(greatest(0, 100 - sum(w)) AS BIGINT) AS derived FROM e WHERE n <= 5 GROUP BY idc"""
    ),
    "agg_bad_rates": S(
        """SELECT band, grp, count(*) AS n, round(avg(bad), 6) AS rate FROM (SELECT f.band, f.grp, CAST(1 - l.quality AS DOUBLE) AS bad FROM labels l JOIN frame f ON f.id = l.doc_id) AS x GROUP BY GROUPING SETS ((band), (grp), ())"""
    ),
    "agg_marginals": S("""SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())"""),
    "agg_quantiles_linear": S(
        """SELECT lang, count(*) AS n, round(percentile(n_chars, 1e-1), 1) AS p10, round(percentile(n_chars, 25e-2), 1) AS p25, round(percentile(n_chars, 5e-1), 1) AS median, round(percentile(n_chars, 75e-2), 1) AS p75, round(percentile(n_chars, 9e-1), 1) AS p90, round(avg(n_chars), 1) AS mean FROM documents GROUP BY lang"""
    ),
    "agg_quantile_nearest": S(
        """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS c FROM documents) SELECT lang, max(CASE WHEN rn = greatest(1, CAST(ceil(5 * c / 10e0) AS BIGINT)) THEN n_chars END) AS p50, max(CASE WHEN rn = greatest(1, CAST(ceil(9 * c / 10e0) AS BIGINT)) THEN n_chars END) AS p90 FROM r GROUP BY lang"""
    ),
    "agg_year_bucket_stats": S(
        """WITH p AS (SELECT paper, bucket, max(yr) AS yr, sum(words) AS w FROM papers GROUP BY paper, bucket) SELECT bucket, yr, count(*) AS n_papers, CAST(sum(w) AS BIGINT) AS words FROM p GROUP BY bucket, yr"""
    ),
    "agg_min_support": S("""SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang HAVING count(*) >= 5"""),
    "agg_partial_final": S("""WITH f AS (SELECT doc_id % 100 AS paper, source, count(*) AS files, sum(n_chars) AS chars FROM documents GROUP BY doc_id % 100, source), p AS (SELECT paper, sum(files) AS files, sum(chars) AS chars FROM f GROUP BY paper)
        SELECT count(*) AS n_papers, CAST(sum(files) AS BIGINT) AS files, CAST(sum(chars) AS BIGINT) AS chars FROM p"""),
    "agg_leak_rate": S(
        """WITH t AS (SELECT doc_id, text LIKE '%@%' AS p1, text LIKE '%token = %' AS p2, text RLIKE '[0-9]{16}' AS p3, text RLIKE '[*]{3}' AS p4, text LIKE '%!!%' AS p5, text LIKE '%License%' AS p6 FROM documents)
        SELECT count(*) AS n, count(*) FILTER (WHERE p1) AS c1, count(*) FILTER (WHERE p2) AS c2, count(*) FILTER (WHERE p3) AS c3, count(*) FILTER (WHERE p4) AS c4, count(*) FILTER (WHERE p5) AS c5, count(*) FILTER (WHERE p6) AS c6, round(count(*) FILTER (WHERE p1 OR p2 OR p3 OR p4 OR p5 OR p6) / CAST(count(*) AS DOUBLE), 6) AS rate FROM t"""
    ),
    "agg_identity_tiers": S(
        """WITH p AS (SELECT a.doc_id, a.text AS x, b.text AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT CASE WHEN x = y THEN 'strict' WHEN regexp_replace(x, '[ \\n\\t]+', ' ') = regexp_replace(y, '[ \\n\\t]+', ' ') THEN 'normalised' ELSE 'diverged' END AS tier, count(*) AS n FROM p GROUP BY 1""",
        """WITH p AS (SELECT a.doc_id, a.text AS x, b.text AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT CASE WHEN x = y THEN 'strict' WHEN regexp_replace(x, '[ \\n\\t]+', ' ', 'g') = regexp_replace(y, '[ \\n\\t]+', ' ', 'g') THEN 'normalised' ELSE 'diverged' END AS tier, count(*) AS n FROM p GROUP BY 1""",
    ),
    "agg_histogram": S("""SELECT label, count(*) AS n FROM embeddings GROUP BY label"""),
    "agg_anchor_density": S("""SELECT event_type, round(count(*) FILTER (WHERE value > 50) / CAST(nullif(count(*) FILTER (WHERE value > 10), 0) AS DOUBLE), 6) AS density FROM events GROUP BY event_type"""),
    "agg_dashboard_funnel": S(
        """WITH w AS (SELECT idc, stage, max_by(status, seq) AS s FROM cells GROUP BY idc, stage)
        SELECT idc, max(CASE WHEN stage = 'click' THEN s END) AS click, max(CASE WHEN stage = 'view' THEN s END) AS view_, max(CASE WHEN stage = 'signup' THEN s END) AS signup, CASE WHEN count(*) FILTER (WHERE s = 'ok') = count(*) THEN 'done' WHEN count(*) FILTER (WHERE s = 'ok') > 0 THEN 'partial' ELSE 'open' END AS word FROM w GROUP BY idc"""
    ),
    "agg_usage_upsert_sum": S("""SELECT l_orderkey, count(*) AS calls, CAST(sum(l_quantity) AS BIGINT) AS tokens, round(sum(l_tax), 4) AS latency FROM lineitem GROUP BY l_orderkey"""),
    "agg_dup_check": S("""SELECT sha2(text, 256) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"""),
    "agg_cross_run_history": S(
        """SELECT idc, array_join(array_sort(collect_list(run || ':' || lpad(CAST(seq AS STRING), 8, '0') || ':' || status)), ';') AS history FROM cells WHERE stage = 'error' GROUP BY idc""",
        """SELECT idc, array_to_string(list_sort(list(run || ':' || lpad(CAST(seq AS VARCHAR), 8, '0') || ':' || status)), ';') AS history FROM cells WHERE stage = 'error' GROUP BY idc""",
    ),
    "agg_reconcile": S(
        """WITH pool AS (SELECT idc FROM cells WHERE status = 'ok' INTERSECT SELECT idc FROM claims WHERE op = 'acquire'), man AS (SELECT DISTINCT idc FROM cells WHERE value > 100)
        SELECT (SELECT count(*) FROM pool) AS pool, (SELECT count(*) FROM (SELECT * FROM pool EXCEPT SELECT * FROM man) AS a) AS unlisted, (SELECT count(*) FROM (SELECT * FROM man EXCEPT SELECT * FROM pool) AS b) AS unbacked"""
    ),
    "agg_window_balance": S(
        """WITH e AS (SELECT CAST(floor(event_id / 4e2) AS BIGINT) AS k, value FROM events) SELECT e.k, count(*) AS calls, CAST(floor(percentile(e.value, 5e-1)) AS BIGINT) AS median, max(e.value) AS top, count(*) FILTER (WHERE e.value > 50) AS hits, count(*) = 400 AS balanced FROM e GROUP BY e.k"""
    ),
    "agg_recent_window": S("""SELECT count(*) FILTER (WHERE event_type = 'view') AS n200, count(*) FILTER (WHERE event_type = 'error') AS n429, round(coalesce(sum(value), 0) / 600e0, 6) AS per_second FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00' AND ts <= TIMESTAMP '2024-01-30 18:00:00'"""),
    "agg_status_mix": S("""SELECT s, count(*) AS n FROM (SELECT idc, stage, max_by(status, seq) AS s FROM cells GROUP BY idc, stage) AS x GROUP BY s"""),
    "agg_token_survival": S(
        """WITH a AS (SELECT DISTINCT conv_id, turn, explode(regexp_extract_all(src, '([A-Za-z]+)', 1)) AS t FROM pairs), b AS (SELECT DISTINCT conv_id, turn, explode(regexp_extract_all(tgt, '([A-Za-z]+)', 1)) AS t FROM pairs)
        SELECT a.conv_id, a.turn, count(*) AS source_tokens, count(b.t) AS kept, count(*) - count(b.t) AS missing FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.t = b.t GROUP BY a.conv_id, a.turn""",
        """WITH a AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(src, '([A-Za-z]+)', 1)) AS t FROM pairs), b AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(tgt, '([A-Za-z]+)', 1)) AS t FROM pairs)
        SELECT a.conv_id, a.turn, count(*) AS source_tokens, count(b.t) AS kept, count(*) - count(b.t) AS missing FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.t = b.t GROUP BY a.conv_id, a.turn""",
    ),
    "agg_new_vs_prev": S("""SELECT stage, count(*) FILTER (WHERE variant = 0) AS n_new, count(*) FILTER (WHERE variant = 1) AS n_prev, count(DISTINCT CASE WHEN variant = 0 THEN idc END) AS ids_new, count(DISTINCT CASE WHEN variant = 1 THEN idc END) AS ids_prev FROM cells WHERE status = 'fail' GROUP BY stage"""),
    "agg_accuracy_arms": S(
        """WITH r AS (SELECT arm, status, value, row_number() OVER (PARTITION BY arm ORDER BY value, seq) AS rn, count(*) OVER (PARTITION BY arm) AS c FROM cells) SELECT arm, count(*) AS n, round(count(*) FILTER (WHERE status <> 'skip') / CAST(count(*) AS DOUBLE), 6) AS coverage, max(CASE WHEN rn = CAST(floor(c / 2e0) AS BIGINT) + 1 THEN value END) AS p50, max(CASE WHEN rn = CAST(floor(9 * c / 10e0) AS BIGINT) + 1 THEN value END) AS p90, count(*) FILTER (WHERE status = 'lost') AS missed FROM r GROUP BY arm"""
    ),
    "agg_status_tally": S("""SELECT stage, status, count(*) AS n FROM cells GROUP BY stage, status"""),
    "sink_csv_strata": S("""SELECT cls, band, count(*) AS n FROM frame GROUP BY cls, band"""),
}
