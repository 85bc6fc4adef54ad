"""Projections, filters, joins, sorting, set operations: one statement for each operator."""

from corpusweave.plans.sql import Statement as S

PROJECTIONS = {
    # key from two captures, century pivot, ordered bands, group and licence class in one derivation
    "proj_frame_derive": S(
        """WITH a AS (SELECT doc_id, lang, source, n_chars, regexp_extract(source, 'src([0-9]+)', 1) AS key FROM documents),
        b AS (SELECT *, CAST(key AS BIGINT) + 85 AS yy FROM a),
        c AS (SELECT *, CASE WHEN yy % 100 >= 91 THEN 1900 + yy % 100 ELSE 2000 + yy % 100 END AS year FROM b)
        SELECT doc_id, key, year, CASE WHEN year IS NULL THEN 'unknown' WHEN year < 1995 THEN 'b1' WHEN year < 2000 THEN 'b2' ELSE 'b3' END AS band,
        CASE WHEN lang IN ('de', 'en') THEN 'germanic' WHEN lang IN ('fr', 'es') THEN 'romance' ELSE 'other' END AS grp,
        CASE WHEN source LIKE 'src1%' THEN 'open' WHEN source LIKE 'src2%' THEN 'closed' ELSE 'other' END AS license FROM c"""
    ),
    "proj_coalesce_regex_key": S(
        """SELECT page_id, coalesce(nullif(regexp_extract(url, '/([0-9]+)/?$', 1), ''), nullif(regexp_extract(url, '/([0-9]+)', 1), ''), 'none') AS key FROM pages"""
    ),
    "proj_century_pivot": S(
        """SELECT o_orderkey, CASE WHEN year(o_orderdate) % 100 >= 91 THEN 1900 + year(o_orderdate) % 100 ELSE 2000 + year(o_orderdate) % 100 END AS y FROM orders""",
        """SELECT o_orderkey, CAST(CASE WHEN year(o_orderdate) % 100 >= 91 THEN 1900 + year(o_orderdate) % 100 ELSE 2000 + year(o_orderdate) % 100 END AS INTEGER) AS y FROM orders""",
    ),
    "proj_band_case": S(
        """SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'unknown' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'to95' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN '96-97'
        WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN '98-99' ELSE 'from00' END AS band FROM orders"""
    ),
    "proj_category_case": S(
        """SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size' WHEN split_part(p_name, ' ', 2) = 'ring' THEN 'ring' ELSE 'unknown' END AS grp FROM part"""
    ),
    "proj_license_case": S(
        """SELECT doc_id, CASE WHEN text LIKE '%MIT License%' THEN 'mit' WHEN text LIKE '%Apache License%' THEN 'apache' WHEN text LIKE '%General Public License%' THEN 'gpl' WHEN text LIKE '%CC BY%' THEN 'cc' ELSE 'none' END AS license FROM documents"""
    ),
    "proj_list_struct": S(
        """SELECT vec_id, element_at(embedding, 1) AS first_value, CAST(size(embedding) AS BIGINT) AS n, embedding IS NOT NULL AS present FROM embeddings""",
        """SELECT vec_id, embedding[1] AS first_value, CAST(len(embedding) AS BIGINT) AS n, embedding IS NOT NULL AS present FROM embeddings""",
    ),
    "proj_sig_normalise": S(
        """SELECT event_id, regexp_replace(coalesce(nullif(get_json_object(props, '$.sig'), ''), event_type || ':k=' || get_json_object(props, '$.k')), '([a-z]+=)[0-9]+', '$1N') AS sig FROM events""",
        """SELECT event_id, regexp_replace(coalesce(nullif(json_extract_string(props, '$.sig'), ''), event_type || ':k=' || json_extract_string(props, '$.k')), '([a-z]+=)[0-9]+', '\\1N', 'g') AS sig FROM events""",
    ),
}

FILTERS = {
    "filter_select_pipeline": S("""SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source LIKE 'src1%' AND n_chars BETWEEN 100 AND 20000 AND doc_id % 3 <> 0"""),
    "filter_predicate_string": S("""SELECT seq, idc, stage, arm FROM cells WHERE stage = 'click' AND arm = 'alt' AND status = 'ok'"""),
    "filter_eligible": S("""SELECT doc_id FROM documents WHERE lang IN ('fr', 'es') AND n_chars >= 1"""),
    "filter_recent_numeric": S(
        """SELECT p_partkey FROM part WHERE try_cast(substring(lpad(CAST(p_partkey AS STRING), 6, '0'), 3, 4) AS INT) BETWEEN 500 AND 1500""",
        """SELECT p_partkey FROM part WHERE try_cast(substring(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), 3, 4) AS INT) BETWEEN 500 AND 1500""",
    ),
    "filter_json_flag_safe": S(
        """SELECT event_id FROM events WHERE try_variant_get(try_parse_json(props), '$.mock', 'string') IS NULL AND try_variant_get(try_parse_json(props), '$.k', 'int') < 50""",
        """SELECT event_id FROM events WHERE json_extract_string(props, '$.mock') IS NULL AND CAST(json_extract_string(props, '$.k') AS INT) < 50""",
    ),
    "filter_glob_prefix": S("""SELECT p_partkey, p_name, p_name = 'red ring' AS exact FROM part WHERE p_name = 'red ring' OR p_name RLIKE '^red [a-z]+$'"""),
    "filter_seq_after": S("""SELECT event_id, event_type FROM events WHERE event_id > 9000 ORDER BY event_id"""),
    "filter_retention_cutoff": S("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND coalesce(o_orderdate, TIMESTAMP '1990-01-01') < TIMESTAMP '1997-06-01'"""),
    "filter_sig_classify": S(
        """SELECT seq, CASE WHEN status = 'ok' THEN 'none' WHEN stage = 'error' AND status IN ('fail', 'lost') THEN 'fix-code' WHEN status = 'skip' THEN 'declined' WHEN stage LIKE 's%' THEN 'fix-data' ELSE 'look' END AS fix_class FROM cells"""
    ),
    "filter_text_gates": S("""SELECT doc_id, NOT text RLIKE '[A-Za-z]' AS wordless, text RLIKE '^[0-9 .,;:!?-]*$' AS punct_only FROM documents"""),
}

JOINS = {
    "join_left_records_runs": S("""SELECT l.l_orderkey, l.l_linenumber, coalesce(o.o_orderdate, TIMESTAMP '2099-01-01') AS at FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P'"""),
    "join_inner_lookup": S("""SELECT d.lang, count(*) AS n, count(l.doc_id) AS hit, count(*) - count(l.doc_id) AS missed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang"""),
    "join_fallback_key": S(
        """SELECT p.p_partkey, coalesce(a.v, b.v) AS v FROM part p LEFT JOIN (SELECT p_brand, p_type, max(p_size) AS v FROM part WHERE p_size > 45 GROUP BY p_brand, p_type) a
        ON a.p_brand = p.p_brand AND a.p_type = p.p_type LEFT JOIN (SELECT p_brand, max(p_size) AS v FROM part GROUP BY p_brand) b ON b.p_brand = p.p_brand"""
    ),
    "join_semi_filter": S("""SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)"""),
    "join_anti_existing": S("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""),
    "join_full_outer_diff": S(
        """WITH a AS (SELECT idc, stage, max_by(status, seq) AS s FROM cells WHERE variant = 0 GROUP BY idc, stage), b AS (SELECT idc, stage, max_by(status, seq) AS s FROM cells WHERE variant = 1 GROUP BY idc, stage)
        SELECT coalesce(a.idc, b.idc) AS idc, coalesce(a.stage, b.stage) AS stage, coalesce(a.s, '(absent)') AS a_status, coalesce(b.s, '(absent)') AS b_status FROM a FULL OUTER JOIN b ON a.idc = b.idc AND a.stage = b.stage
        WHERE coalesce(a.s, '(absent)') <> coalesce(b.s, '(absent)')"""
    ),
    "join_self_regression": S(
        """WITH w AS (SELECT idc, arm, max_by(status, seq) AS s FROM cells GROUP BY idc, arm) SELECT a.idc, a.s AS alt_status FROM w a JOIN w b ON a.idc = b.idc WHERE a.arm = 'alt' AND b.arm = 'base' AND b.s = 'ok' AND a.s <> 'ok'"""
    ),
    "join_correlated_max": S("""SELECT o_orderkey, coalesce((SELECT max(l_linenumber) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey), 0) AS last_line FROM orders o"""),
    "join_latest_open_claim": S("""SELECT idc, slot FROM (SELECT idc, slot, max_by(op, seq) AS op FROM claims GROUP BY idc, slot) AS x WHERE op = 'acquire'"""),
    "join_in_latest_group": S(
        """WITH w AS (SELECT idc, run, stage, max_by(status, seq) AS s FROM cells GROUP BY idc, run, stage) SELECT idc, max(CASE WHEN s IN ('fail', 'lost') THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN s = 'ok' THEN 1 ELSE 0 END) = 0 AS attempted FROM w WHERE s <> 'skip' GROUP BY idc"""
    ),
    "join_latest_multi_source": S(
        """WITH k AS (SELECT DISTINCT idc FROM cells), a AS (SELECT idc, max_by(status, seq) AS s FROM cells WHERE stage = 'click' GROUP BY idc), b AS (SELECT idc, max_by(status, seq) AS s FROM cells WHERE stage = 'view' AND value > 100 GROUP BY idc),
        c AS (SELECT idc, max_by(status, seq) AS s FROM cells WHERE stage = 'signup' AND value > 150 GROUP BY idc)
        SELECT k.idc, coalesce(c.s, b.s, a.s) AS status, CASE WHEN c.idc IS NULL THEN 'no row' WHEN c.s = 'skip' THEN 'true' ELSE 'false' END AS flag FROM k LEFT JOIN a ON a.idc = k.idc LEFT JOIN b ON b.idc = k.idc LEFT JOIN c ON c.idc = k.idc"""
    ),
    "join_nearest_truth": S(
        """WITH d AS (SELECT a.event_id, b.event_id AS other, abs(a.value - b.value) AS dist FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'signup')
        SELECT event_id, other FROM (SELECT event_id, other, row_number() OVER (PARTITION BY event_id ORDER BY dist, other) AS n FROM d) AS x WHERE n = 1"""
    ),
    "join_left_history": S(
        """SELECT l.l_partkey, max_by(o.o_orderstatus, l.l_orderkey * 10 + l.l_linenumber) AS last_status, count(*) AS n FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_partkey"""
    ),
    "join_exists_guard": S("""SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'O')"""),
    "join_three_way_study": S(
        """SELECT (SELECT count(*) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey) AS matched, (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)) AS orders_only,
        (SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)) AS customers_only"""
    ),
    "join_prefer_arm": S(
        """SELECT idc, stage, arm, seq FROM (SELECT idc, stage, arm, seq, row_number() OVER (PARTITION BY idc, stage ORDER BY CASE arm WHEN 'alt' THEN 0 ELSE 1 END, seq DESC) AS n FROM cells) AS x WHERE n = 1"""
    ),
    "join_overlap_ratio": S(
        """WITH a AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey), b AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey)
        SELECT a.k, round(a.q / CAST(b.q AS DOUBLE), 6) AS ratio FROM a JOIN b ON a.k = b.k WHERE a.q > 50 AND b.q > 50"""
    ),
    "join_asof_prev_run": S("""SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders"""),
    "join_domain_last_done": S(
        """WITH w AS (SELECT idc, max_by(status, seq) AS last_status, max(seq) AS last_seq, max(CASE WHEN status = 'ok' THEN seq END) AS any_done, max(CASE WHEN status = 'ok' AND stage = 'click' THEN seq END) AS in_domain FROM cells GROUP BY idc)
        SELECT idc, CASE WHEN last_status = 'skip' THEN any_done ELSE coalesce(in_domain, any_done) END AS done_seq FROM w"""
    ),
    "join_time_suspect": S(
        """WITH c AS (SELECT idc, max(ts) AS t FROM cells WHERE stage = 'click' GROUP BY idc), f AS (SELECT idc, max(ts) AS t FROM cells WHERE stage = 'view' GROUP BY idc) SELECT c.idc FROM c JOIN f ON c.idc = f.idc AND c.t > f.t"""
    ),
    "join_freshness_pick": S(
        """WITH c AS (SELECT idc, max_by(status, seq) AS s, max(seq) AS q FROM cells WHERE stage = 'click' GROUP BY idc), f AS (SELECT idc, max_by(status, seq) AS s, max(seq) AS q FROM cells WHERE stage = 'view' GROUP BY idc)
        SELECT c.idc, CASE WHEN f.idc IS NULL THEN 'no-fix' WHEN f.s = 'lost' THEN 'lost' WHEN f.s = 'skip' THEN 'declined' WHEN f.q < c.q THEN 'stale' WHEN f.s = 'fail' THEN 'failed' ELSE 'taken' END AS reason FROM c LEFT JOIN f ON f.idc = c.idc"""
    ),
    "join_precedence_merge": S(
        """SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY layer) AS n FROM (SELECT p_partkey AS k, p_name AS v, 1 AS layer FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_brand, 2 FROM part) AS u) AS x WHERE n = 1"""
    ),
    "join_anchor_name": S(
        """WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click' AND value > 60), b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'view' AND value > 60)
        SELECT count(a.k) AS n_a, count(b.k) AS n_b, sum(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS common, sum(CASE WHEN b.k IS NULL THEN 1 ELSE 0 END) AS lost, sum(CASE WHEN a.k IS NULL THEN 1 ELSE 0 END) AS added FROM a FULL OUTER JOIN b ON a.k = b.k""",
        """WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click' AND value > 60), b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'view' AND value > 60)
        SELECT count(a.k) AS n_a, count(b.k) AS n_b, CAST(sum(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS common, CAST(sum(CASE WHEN b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN a.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS added FROM a FULL OUTER JOIN b ON a.k = b.k""",
    ),
    "join_interp_position": S(
        """WITH m AS (SELECT event_id, user_id, CAST(event_id AS DOUBLE) AS x, CASE WHEN event_type = 'click' THEN value END AS y FROM events),
        w AS (SELECT event_id, x, y, max(CASE WHEN y IS NOT NULL THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo, min(CASE WHEN y IS NOT NULL THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM m)
        SELECT w.event_id, round(CASE WHEN a.x = b.x THEN a.y ELSE a.y + (b.y - a.y) * (w.x - a.x) / (b.x - a.x) END, 3) AS y FROM w LEFT JOIN m a ON a.event_id = w.lo LEFT JOIN m b ON b.event_id = w.hi"""
    ),
    "join_identity_alias": S(
        """WITH u AS (SELECT page_id, lower(regexp_extract(url, '://(?:www[.]|m[.]|blog[.])?([^/?#]+)', 1)) AS host FROM pages) SELECT host, count(*) AS n, min(page_id) AS canon FROM u GROUP BY host"""
    ),
    "join_blob_resolve": S("""SELECT d.doc_id, length(coalesce(b.text, d.text)) AS n FROM documents d LEFT JOIN (SELECT doc_id, text FROM documents WHERE n_chars > 4096) b ON b.doc_id = d.doc_id""",
        """SELECT d.doc_id, CAST(length(coalesce(b.text, d.text)) AS INTEGER) AS n FROM documents d LEFT JOIN (SELECT doc_id, text FROM documents WHERE n_chars > 4096) b ON b.doc_id = d.doc_id"""),
    "box_overlap_join": S(
        """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS box, l_quantity AS x0, l_quantity + 10 AS x1 FROM lineitem) SELECT a.page, a.box AS a, c.box AS b, least(a.x1, c.x1) - greatest(a.x0, c.x0) AS overlap FROM b a JOIN b c ON a.page = c.page AND a.box < c.box WHERE least(a.x1, c.x1) - greatest(a.x0, c.x0) > 6"""
    ),
}

SORTS = {
    "sort_page_offset": S("""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500 OFFSET 100"""),
    "topk_signatures": S("""SELECT stage || ':' || status AS sig, count(*) AS n, min(seq) AS first_seq FROM cells GROUP BY stage, status ORDER BY n DESC, first_seq LIMIT 10"""),
    "topk_worst": S("""SELECT doc_id, quality, toxic FROM labels ORDER BY quality, toxic DESC, doc_id LIMIT 30"""),
    "topk_share_clusters": S(
        """SELECT source, lang, share FROM (SELECT source, lang, round(n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE), 6) AS share, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) AS c) AS x WHERE r <= 5"""
    ),
    "sort_status_rank": S(
        """SELECT status, CASE status WHEN 'ok' THEN 0 WHEN 'warn' THEN 1 WHEN 'fail' THEN 2 WHEN 'skip' THEN 3 ELSE -1 END AS rnk, count(*) AS n FROM cells GROUP BY status ORDER BY rnk, status"""
    ),
    "sort_year_then_month": S("""SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 1, 2"""),
    "sort_exact_match_first": S("""SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' ORDER BY p_name = 'red ring' DESC, p_partkey DESC LIMIT 50"""),
    "limit_recent_warnings": S("""SELECT * FROM (SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100) AS x ORDER BY event_id"""),
    "sort_doc_order": S(
        """WITH RECURSIVE t(id, path, depth) AS (SELECT CAST(r_regionkey AS BIGINT), lpad(CAST(r_regionkey AS STRING), 3, '0'), CAST(0 AS BIGINT) FROM region UNION ALL SELECT CAST(100 + n.n_nationkey AS BIGINT), t.path || '/' || lpad(CAST(n.n_nationkey AS STRING), 3, '0'), t.depth + 1 FROM t JOIN nation n ON n.n_regionkey = t.id AND t.depth = 0)
        SELECT id, path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS pos FROM t"""
    ),
}

SETS = {
    "set_union_tables": S("""SELECT k, max_by(v, q) AS v FROM (SELECT user_id AS k, event_type AS v, event_id AS q FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, event_id FROM events WHERE event_id % 2 = 1) AS u GROUP BY k"""),
    "set_union_ids": S("""SELECT doc_id FROM documents UNION SELECT doc_id FROM labels"""),
    "set_intersect": S("""SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1"""),
    "set_except": S("""SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"""),
    "set_multiset_diff": S(
        """WITH a AS (SELECT event_type AS t, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY event_type), b AS (SELECT event_type AS t, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY event_type)
        SELECT coalesce(a.t, b.t) AS t, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS only_a, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS only_b FROM a FULL OUTER JOIN b ON a.t = b.t"""
    ),
    "set_insert_ignore": S(
        """WITH h AS (SELECT event_id, sha2(event_type || ':' || CAST(user_id % 50 AS STRING), 256) AS sha FROM events) SELECT sha, min(event_id) AS kept, count(*) - 1 AS skipped FROM h GROUP BY sha"""
    ),
    "set_cross_items_stages": S("""SELECT n_nationkey, r_name, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY r_regionkey) AS BIGINT) AS stage_no FROM nation CROSS JOIN region"""),
    "items_grid": S("""SELECT n_name, r_name, v FROM nation CROSS JOIN region CROSS JOIN (SELECT 'a' AS v UNION ALL SELECT 'b') AS c"""),
}

STATEMENTS = PROJECTIONS | FILTERS | JOINS | SORTS | SETS
