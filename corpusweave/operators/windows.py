"""Window operators, lifecycle and DML operators as queries over ordered keys."""

from corpusweave.plans.sql import Statement as S

WINDOWS = {
    "win_last_wins": S("""SELECT idc, arm, run, variant, stage, status, seq FROM (SELECT idc, arm, run, variant, stage, status, seq, row_number() OVER (PARTITION BY idc, arm, run, variant, stage ORDER BY seq DESC) AS n FROM cells) AS x WHERE n = 1"""),
    "win_row_number_top1": S("""SELECT idc, seq, ts FROM (SELECT idc, seq, ts, row_number() OVER (PARTITION BY idc ORDER BY ts DESC, seq DESC) AS n FROM cells WHERE status <> 'skip' AND props IS NOT NULL) AS x WHERE n = 1"""),
    "win_first_wins": S("""SELECT idc, min_by(stage, seq) AS first_stage FROM cells GROUP BY idc"""),
    "win_prev_rate_drop": S(
        """WITH m AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS ym, count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) AS rate FROM orders GROUP BY 1), p AS (SELECT ym, rate, lag(rate) OVER (ORDER BY ym) AS prev FROM m)
        SELECT ym, round(rate, 6) AS rate, round(prev, 6) AS prev FROM p WHERE rate < prev - 1e-9"""
    ),
    "win_queue_position": S("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS pos FROM orders"""),
    "win_cumulative_budget": S(
        """WITH t AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS b, o_orderdate FROM orders), x AS (SELECT o_custkey, o_orderkey, b, sum(b) OVER (PARTITION BY o_custkey) - 1000000 AS excess, coalesce(sum(b) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS released FROM t)
        SELECT o_custkey, o_orderkey, b FROM x WHERE released < excess"""
    ),
    "win_keep_last_n": S("""SELECT idc, seq FROM (SELECT idc, seq, row_number() OVER (PARTITION BY idc ORDER BY seq DESC) AS n FROM cells) AS x WHERE n <= 20"""),
    "win_round_robin": S(
        # a row's place follows from the sizes of the twelve groups, so the whole order is never sorted in one task
        """WITH r AS (SELECT o_orderkey, month(o_orderdate) AS m, row_number() OVER (PARTITION BY month(o_orderdate) ORDER BY o_orderkey) AS rn FROM orders),
        g AS (SELECT collect_list(struct(m, n)) AS sizes FROM (SELECT month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1) AS x),
        j AS (SELECT o_orderkey, m, rn, (SELECT sizes FROM g) AS sizes FROM r)
        SELECT o_orderkey, CAST(aggregate(sizes, 0L, (a, x) -> a + least(x.n, rn - 1) + CASE WHEN x.m <= m AND x.n >= rn THEN 1 ELSE 0 END) AS BIGINT) AS pos FROM j""",
        """WITH r AS (SELECT o_orderkey, month(o_orderdate) AS m, row_number() OVER (PARTITION BY month(o_orderdate) ORDER BY o_orderkey) AS rn FROM orders) SELECT o_orderkey, CAST(row_number() OVER (ORDER BY rn, m) AS BIGINT) AS pos FROM r""",
    ),
    "win_pps_systematic": S(
        """WITH m AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS band, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY 1, 2), c AS (SELECT band, m, n, sum(n) OVER (PARTITION BY band ORDER BY m) AS hi, sum(n) OVER (PARTITION BY band) AS t FROM m),
        k AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS k FROM region UNION ALL SELECT CAST(6 AS BIGINT)) SELECT DISTINCT c.band, c.m FROM c JOIN k ON (2 * k.k - 1) * c.t > 12 * (c.hi - c.n) AND (2 * k.k - 1) * c.t <= 12 * c.hi"""
    ),
    "win_rolling_rate": S(
        # a half hour is a group with the one before it; by the place within the half hour, running counts and minima of both give each
        # window: the own events up to that place and the earlier ones from it on, so no frame slides over its rows
        """WITH e AS (SELECT event_id, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events),
        o AS (SELECT event_id, us, pmod(us, 1800000000) AS place, (us - pmod(us, 1800000000)) div 1800000000 AS own FROM e),
        c AS (SELECT event_id, us, place, own, explode(array(own, own + 1)) AS cell FROM o),
        w AS (SELECT event_id, us, own, cell, count_if(own = cell) OVER up AS n1, min(CASE WHEN own = cell THEN us END) OVER up AS u1, count_if(own < cell) OVER down AS n0, min(CASE WHEN own < cell THEN us END) OVER down AS u0 FROM c
            WINDOW up AS (PARTITION BY cell ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY cell ORDER BY place DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        x AS (SELECT event_id, us, n1 + n0 AS n, coalesce(u0, u1) AS first FROM w WHERE own = cell)
        SELECT event_id, round((n - 1) / ((us - first) / 1e6), 6) AS rate FROM x WHERE n >= 2 AND us - first >= 120000000""",
        """WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events), w AS (SELECT event_id, us, min(us) OVER (ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS u0, count(*) OVER (ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS n FROM e)
        SELECT event_id, round((n - 1) / ((us - u0) / 1e6), 6) AS rate FROM w WHERE n >= 2 AND us - u0 >= 120000000""",
    ),
    "win_seq_gap": S("""SELECT idc, seq, prev FROM (SELECT idc, seq, lag(seq) OVER (PARTITION BY idc ORDER BY seq) AS prev FROM cells) AS x WHERE prev IS NOT NULL AND seq > prev + 300"""),
    "win_tiling_check": S(
        """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS n, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, l_partkey FROM lineitem), t AS (SELECT l_orderkey, a, a + n AS b, lag(a + n) OVER (PARTITION BY l_orderkey ORDER BY a, l_partkey) AS prev FROM s)
        SELECT l_orderkey, min(a) = 0 AS starts, max(CASE WHEN prev IS NOT NULL AND prev <> a THEN 1 ELSE 0 END) = 0 AS contiguous, max(b) AS total FROM t GROUP BY l_orderkey""",
        dealt=("lineitem", "l_orderkey"),
    ),
    "win_section_spans": S(
        """WITH m AS (SELECT idc, seq, stage, lead(seq) OVER (PARTITION BY idc ORDER BY seq) AS nxt, max(CASE WHEN stage = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY idc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS appendix FROM cells WHERE value > 40) SELECT idc, seq, nxt - seq AS span, appendix = 1 AS appendix FROM m"""
    ),
    "win_drift_residual": S(
        """WITH f AS (SELECT user_id, regr_slope(value, CAST(event_id AS DOUBLE)) AS a, regr_intercept(value, CAST(event_id AS DOUBLE)) AS b FROM events GROUP BY user_id) SELECT e.event_id, round(e.value - (f.a * e.event_id + f.b), 3) AS residual FROM events e JOIN f ON f.user_id = e.user_id WHERE abs(e.value - (f.a * e.event_id + f.b)) > 150"""
    ),
}

#: DML as projections: the state a table has after the statement.
DML = {
    "dml_upsert_latest": S("""SELECT idc, stage, max_by(status, seq) AS status, min(ts) AS created, max(ts) AS updated FROM cells GROUP BY idc, stage"""),
    "dml_transition_guard": S(
        """WITH allowed AS (SELECT 'ok' AS a, 'warn' AS b UNION ALL SELECT 'warn', 'fail' UNION ALL SELECT 'warn', 'ok' UNION ALL SELECT 'fail', 'ok' UNION ALL SELECT 'skip', 'ok'), m AS (SELECT idc, seq, status, lag(status) OVER (PARTITION BY idc, stage ORDER BY seq) AS prev FROM cells)
        SELECT m.idc, m.seq, m.prev, m.status, allowed.a IS NOT NULL OR m.prev = m.status AS legal FROM m LEFT JOIN allowed ON allowed.a = m.prev AND allowed.b = m.status WHERE m.prev IS NOT NULL"""
    ),
    "dml_startup_recover": S("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey % 10 = 0 THEN 'needs_auth' WHEN o_orderstatus = 'O' THEN 'interrupted' ELSE o_orderstatus END AS status FROM orders"""),
    "dml_delete_guard_cascade": S("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 7 = 0 AND o.o_orderstatus <> 'O')"""),
    "dml_reuse_lookup": S("""SELECT o_custkey, max_by(o_orderkey, (CAST(year(o_orderdate) AS BIGINT) * 100 + month(o_orderdate)) * 10000000 + o_orderkey) AS reuse FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY o_custkey"""),
    "dml_chunk_flush": S("""SELECT o.o_orderkey, count(l.l_linenumber) AS chunks, count(*) FILTER (WHERE l.l_linestatus = 'F') AS done, round(coalesce(sum(l.l_extendedprice), 0), 2) AS counters FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey"""),
    "dml_cache_lru": S(
        # the 300 latest hits by a top-k; hits have numbers of their own
        """WITH h AS (SELECT idc, stage, max(seq) AS last_hit, count(*) AS hits FROM cells GROUP BY idc, stage) SELECT idc, stage, hits, last_hit >= (SELECT min(last_hit) FROM (SELECT last_hit FROM h ORDER BY last_hit DESC LIMIT 300) AS t) AS kept FROM h""",
        """WITH h AS (SELECT idc, stage, max(seq) AS last_hit, count(*) AS hits FROM cells GROUP BY idc, stage), r AS (SELECT idc, stage, hits, row_number() OVER (ORDER BY last_hit DESC) AS n FROM h) SELECT idc, stage, hits, n <= 300 AS kept FROM r""",
    ),
    "life_dedup_verdict": S(
        """WITH c AS (SELECT idc, max_by(op, seq) AS op, count(*) FILTER (WHERE reap) AS reaps FROM claims GROUP BY idc), v AS (SELECT idc, count(*) FILTER (WHERE status = 'ok') AS good, count(*) FILTER (WHERE status = 'lost') AS lost, max(seq) AS top FROM cells GROUP BY idc)
        SELECT v.idc, CASE WHEN v.top > 9990 THEN 'unsealed' WHEN c.op = 'acquire' AND c.reaps < 3 THEN 'claimed' WHEN v.good > 20 THEN 'verified' WHEN v.lost > 0 THEN 'missing' ELSE 'absent' END AS verdict FROM v JOIN c ON c.idc = v.idc"""
    ),
    "life_manifest_fold": S("""SELECT idc, count(*) FILTER (WHERE s IN ('ok', 'warn')) AS alive, count(*) FILTER (WHERE s IN ('lost')) AS dead FROM (SELECT idc, stage, run, max_by(status, seq) AS s FROM cells GROUP BY idc, stage, run) AS x GROUP BY idc"""),
    "life_vault_verify": S("""SELECT doc_id, sha2(text, 256) AS sha, length(text) = n_chars AS sized FROM documents WHERE substring(sha2(CAST(doc_id AS STRING), 256), 1, 1) IN ('0', '1', '2', '3')"""),
    "life_lake_state": S("""SELECT idc, max_by(status, seq) AS state, max_by(value, seq) > 100 AS pinned, count(DISTINCT stage) = 5 AS complete FROM cells GROUP BY idc"""),
    "life_sweep_stale": S("""SELECT DISTINCT idc, run FROM cells s WHERE stage = 'click' AND NOT EXISTS (SELECT 1 FROM cells t WHERE t.idc = s.idc AND t.run = s.run AND t.stage = 'purchase')"""),
    "life_cost_budget": S(
        """WITH c AS (SELECT idc, seq, CAST(floor(value * 100) AS BIGINT) AS cost, sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY idc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM cells) SELECT idc, count(*) FILTER (WHERE spent <= 100000) AS within, count(*) AS n, CAST(max(CASE WHEN spent <= 100000 THEN spent END) AS BIGINT) AS used FROM c GROUP BY idc"""
    ),
}

STATEMENTS = WINDOWS | DML
