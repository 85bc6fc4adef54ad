"""Scalar functions, text operators and pair checks as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusweave.functions import algorithms, pairs
from corpusweave.plans.sql import Statement as S
from corpusweave.sources.tables import read

# Common function words by language, for the prose gate.
STOP = ("the", "of", "and", "to", "in", "is", "der", "die", "und", "den", "le", "la", "de", "et", "les", "que", "el", "en", "los")
_STOPS = ", ".join(f"'{w}'" for w in STOP)

SCALARS = {
    "fn_est_tokens": S(
        """SELECT doc_id, CAST(regexp_count(text, '[\\\\x{3400}-\\\\x{4DBF}\\\\x{4E00}-\\\\x{9FFF}\\\\x{F900}-\\\\x{FAFF}]') + floor((length(regexp_replace(text, '[ \\n\\t\\r]', '')) - regexp_count(text, '[\\\\x{3400}-\\\\x{4DBF}\\\\x{4E00}-\\\\x{9FFF}\\\\x{F900}-\\\\x{FAFF}]')) / 4e0) AS BIGINT) AS tokens FROM documents""",
        """SELECT doc_id, CAST(floor(length(regexp_replace(text, '[ \\n\\t\\r]', '', 'g')) / 4e0) AS BIGINT) AS tokens FROM documents WHERE NOT regexp_matches(text, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]') UNION ALL SELECT doc_id, -1 FROM documents WHERE regexp_matches(text, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]')""",
    ),
    "fn_lev_capped": S(
        """SELECT p_partkey, CAST(CASE WHEN levenshtein(p_name, 'red ring') > 4 THEN 5 ELSE levenshtein(p_name, 'red ring') END AS BIGINT) AS d FROM part"""
    ),
    "fn_prose_text": S(
        """SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[*#$%&]+', ' '), '[ \\n]+', ' ')) AS prose FROM documents""",
        """SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[*#$%&]+', ' ', 'g'), '[ \\n]+', ' ', 'g')) AS prose FROM documents""",
    ),
    "fn_token_overlap": S(
        """WITH t AS (SELECT conv_id, turn, array_distinct(regexp_extract_all(lower(src), '([a-z]+)', 1)) AS a, array_distinct(regexp_extract_all(lower(tgt), '([a-z]+)', 1)) AS b FROM pairs) SELECT conv_id, turn, round(size(array_intersect(a, b)) / CAST(nullif(least(size(a), size(b)), 0) AS DOUBLE), 6) AS overlap FROM t""",
        """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(src), '([a-z]+)', 1)) AS a, list_distinct(regexp_extract_all(lower(tgt), '([a-z]+)', 1)) AS b FROM pairs) SELECT conv_id, turn, round(len(list_intersect(a, b)) / CAST(nullif(least(len(a), len(b)), 0) AS DOUBLE), 6) AS overlap FROM t""",
    ),
    "fn_norm_chars": S(
        """SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]', '') AS s FROM part""",
        """SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]', '', 'g') AS s FROM part""",
    ),
    "fn_norm_term_key": S("""SELECT p_partkey, CASE WHEN lower(p_name) RLIKE '(ss|us|is)$' THEN lower(p_name) ELSE regexp_replace(lower(p_name), 's$', '') END AS k FROM part"""),
    "fn_sha_key": S("""SELECT p_partkey, sha2(p_name || '|' || p_brand || CASE WHEN p_size > 25 THEN '|' || p_type ELSE '' END, 256) AS k FROM part"""),
    "fn_id_canon": S(
        """SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^?#]*)', 1)), '^(www|m|blog)[.]|(/|[.]html)$', '') AS canon FROM pages""",
        """SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^?#]*)', 1)), '^(www|m|blog)[.]|(/|[.]html)$', '', 'g') AS canon FROM pages""",
    ),
    "fn_member_parse": S("""SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS num, regexp_extract(url, '[0-9]+[.]([a-z]+)', 1) AS ext FROM pages"""),
    "fn_escape_component": S("""SELECT page_id, replace(replace(replace(url, '%', '%25'), '/', '%2F'), ':', '%3A') AS escaped FROM pages"""),
    "fn_strip_comments": S(
        """SELECT doc_id, regexp_replace(text, '(^|[^\\\\\\\\])%[^\\n]*', '$1') AS body FROM documents""",
        """SELECT doc_id, regexp_replace(text, '(^|[^\\\\])%[^\\n]*', '\\1', 'g') AS body FROM documents""",
    ),
    "fn_detex_words": S(
        """SELECT doc_id, CAST(size(regexp_extract_all(text, '([A-Za-z]+)', 1)) AS BIGINT) AS words FROM documents""",
        """SELECT doc_id, CAST(len(regexp_extract_all(text, '([A-Za-z]+)', 1)) AS BIGINT) AS words FROM documents""",
    ),
    "fn_section_bucket": S(
        """SELECT p_partkey, CASE WHEN p_name RLIKE '^(red|blue)' THEN 'colour' WHEN p_name RLIKE '^(hot|cold)' THEN 'heat' WHEN p_name RLIKE '^(small|large)' THEN 'size' ELSE 'other' END AS bucket FROM part"""
    ),
    "fn_name_category": S("""SELECT page_id, CASE WHEN url LIKE 'https://www.%' THEN 'main' WHEN url LIKE '%://m.%' THEN 'mobile' WHEN url LIKE '%://blog.%' THEN 'blog' ELSE 'plain' END AS cat, CAST(CASE WHEN url LIKE 'https%' THEN 3 ELSE 1 END AS BIGINT) AS weight FROM pages"""),
    "fn_doc_flags": S(
        """SELECT doc_id, concat_ws(',', CASE WHEN text LIKE '%@%' THEN 'mail' END, CASE WHEN text LIKE '%token%' THEN 'token' END, CASE WHEN text LIKE '%License%' THEN 'license' END) AS flags FROM documents"""
    ),
    "fn_flag_csv_set": S(
        """SELECT p_partkey, array_join(array_sort(array_distinct(filter(transform(split(p_name || ', ' || p_brand || ',,' || p_name, ','), x -> trim(x)), x -> x <> ''))), '|') AS flags FROM part""",
        """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(p_name || ', ' || p_brand || ',,' || p_name, ','), lambda x: trim(x)), lambda x: x <> ''))), '|') AS flags FROM part""",
    ),
    "fn_err_signature": S(
        """SELECT event_id, regexp_replace(event_type || ' at ' || props, '[0-9]+', 'N') AS sig FROM events""",
        """SELECT event_id, regexp_replace(event_type || ' at ' || props, '[0-9]+', 'N', 'g') AS sig FROM events""",
    ),
    "fn_status_rank": S("""SELECT seq, CAST(CASE status WHEN 'ok' THEN 3 WHEN 'warn' THEN 2 WHEN 'fail' THEN 1 WHEN 'skip' THEN 0 ELSE -1 END AS BIGINT) AS rnk FROM cells"""),
    "fn_errors_sig": S("""SELECT event_id, event_type || ':' || get_json_object(props, '$.k') AS sig FROM events WHERE event_type = 'error'"""),
    "fn_largest_remainder_frac": S("""SELECT doc_id, CAST(floor(n_chars / 7e0) AS BIGINT) AS base, round(n_chars / 7e0 - floor(n_chars / 7e0), 6) AS frac FROM documents"""),
    "fn_text_gates": S("""SELECT doc_id, NOT text RLIKE '[A-Za-z]' AS wordless, text RLIKE '^[0-9 .,;:!?-]*$' AS punct_only FROM documents"""),
    "fn_log_event_parse": S("""SELECT event_type, regexp_extract(props, '"([a-z]+)"', 1) AS field, count(*) AS n FROM events GROUP BY 1, 2"""),
    "map_title_norm": S(
        """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ')) AS norm FROM part""",
        """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part""",
    ),
}

TEXTS = {
    "txt_prose_gate": S(
        f"""SELECT doc_id, size(array_intersect(array_distinct(split(lower(text), '[^a-z]+')), array({_STOPS}))) >= 3 AS prose FROM documents""",
        f"""SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), [{_STOPS}])) >= 3 AS prose FROM documents""",
    ),
    "txt_placeholder_extract": S(
        """SELECT doc_id, array_join(array_sort(array_distinct(regexp_extract_all(text, '([a-z]{3}[*#$%&]{3})', 1))), ' ') AS ph FROM documents""",
        """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '([a-z]{3}[*#$%&]{3})', 1))), ' ') AS ph FROM documents""",
    ),
    "txt_newline_codec": S(
        """SELECT doc_id, replace(replace(text, '~', '~0'), '\\n', '~1') AS enc, replace(replace(replace(replace(text, '~', '~0'), '\\n', '~1'), '~1', '\\n'), '~0', '~') = text AS round_trip FROM documents""",
        """SELECT doc_id, replace(replace(text, '~', '~0'), chr(10), '~1') AS enc, replace(replace(replace(replace(text, '~', '~0'), chr(10), '~1'), '~1', chr(10)), '~0', '~') = text AS round_trip FROM documents""",
    ),
    "txt_batch_parse": S(
        """SELECT event_id, CASE WHEN size(regexp_extract_all(props, '([0-9]+)', 1)) = 1 THEN regexp_extract(props, '([0-9]+)', 1) END AS seg FROM events""",
        """SELECT event_id, CASE WHEN len(regexp_extract_all(props, '([0-9]+)', 1)) = 1 THEN regexp_extract(props, '([0-9]+)', 1) END AS seg FROM events""",
    ),
    "txt_sentence_ends": S(
        """SELECT doc_id, CAST(size(regexp_extract_all(text, '([.!?][ \\n])', 1)) AS BIGINT) AS ends FROM documents""",
        """SELECT doc_id, CAST(len(regexp_extract_all(text, '([.!?][ \\n])', 1)) AS BIGINT) AS ends FROM documents""",
    ),
    "txt_result_cache": S("""SELECT d.doc_id, sha2(d.source || '|' || d.lang || '|' || CAST(d.n_chars AS STRING), 256) AS k FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)"""),
    "txt_term_vote": S(
        """WITH v AS (SELECT lower(p_name) AS k, p_brand AS t, count(*) AS n FROM part GROUP BY 1, 2) SELECT k, t, n FROM (SELECT k, t, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, t) AS r FROM v) AS x WHERE r = 1"""
    ),
    "txt_usage_index": S(
        """SELECT l_partkey, array_join(array_sort(collect_list(lpad(CAST(l_orderkey AS STRING), 8, '0') || '.' || CAST(l_linenumber AS STRING))), ' ') AS sites FROM lineitem GROUP BY l_partkey""",
        """SELECT l_partkey, array_to_string(list_sort(list(lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || '.' || CAST(l_linenumber AS VARCHAR))), ' ') AS sites FROM lineitem GROUP BY l_partkey""",
    ),
    "txt_src_cut": S(
        """WITH g AS (SELECT idc, seq, seq - 150 * row_number() OVER (PARTITION BY idc ORDER BY seq) AS island FROM cells), i AS (SELECT idc, island, min(seq) AS s, max(seq) AS e, count(*) AS n FROM g GROUP BY idc, island) SELECT idc, s, e, n FROM i"""
    ),
    # word boxes on a page: overlaps by tier
    "txt_layout_findings": S(
        """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS box, l_quantity AS x0, l_quantity + 8 AS x1, l_discount * 1000 AS y0, l_discount * 1000 + 30 AS y1 FROM lineitem),
        o AS (SELECT a.page, (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS area FROM b a JOIN b c ON a.page = c.page AND a.box < c.box AND a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1)
        SELECT page, CASE WHEN max(area) > 120 THEN 'hard' WHEN max(area) > 40 THEN 'warn' ELSE 'clean' END AS tier, count(*) AS n FROM o GROUP BY page"""
    ),
    "heading_detect": S(
        """WITH l AS (SELECT doc_id, explode(split(text, '\\n')) AS line FROM documents) SELECT doc_id, count(*) AS lines_, count(*) FILTER (WHERE length(line) < 40 AND line RLIKE '^[A-Z]' AND NOT line RLIKE '[.]$') AS headings FROM l GROUP BY doc_id""",
        """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines_, count(*) FILTER (WHERE length(line) < 40 AND regexp_matches(line, '^[A-Z]') AND NOT regexp_matches(line, '[.]$')) AS headings FROM l GROUP BY doc_id""",
    ),
}

_COUNTS = {
    "val_decoration": "[*#$%&]{3}", "val_bracket": "[()]", "val_number": "[0-9]+", "val_url": "https?://", "val_newline": "[.]",
    "val_quote": "['\\x22]", "val_upper": "[A-Z]", "val_comma": ",",
}
#: Pair checks that compare counts of a pattern on both sides.
PAIR_CHECKS = {
    name: S(
        f"""SELECT conv_id, turn, CAST(regexp_count(src, '{p}') AS BIGINT) AS n_src, CAST(regexp_count(tgt, '{p}') AS BIGINT) AS n_tgt, regexp_count(src, '{p}') = regexp_count(tgt, '{p}') AS ok FROM pairs""".replace("\\x22", '"').replace("'['\"]'", "'[\\'\"]'"),
        f"""SELECT conv_id, turn, CAST(len(regexp_extract_all(src, '{p}')) AS BIGINT) AS n_src, CAST(len(regexp_extract_all(tgt, '{p}')) AS BIGINT) AS n_tgt, len(regexp_extract_all(src, '{p}')) = len(regexp_extract_all(tgt, '{p}')) AS ok FROM pairs""".replace("['\\x22]", "[''\"]"),
    )
    for name, p in _COUNTS.items()
} | {
    "val_empty": S("""SELECT conv_id, turn, length(trim(tgt)) = 0 AS empty FROM pairs"""),
    "val_echo": S("""SELECT conv_id, turn, lower(src) = lower(tgt) AS echo FROM pairs"""),
    "val_length_ratio": S("""SELECT conv_id, turn, round(length(tgt) / CAST(greatest(length(src), 1) AS DOUBLE), 6) AS ratio, length(tgt) < 2e-1 * length(src) AS too_short, length(tgt) > 5e0 * length(src) AS too_long FROM pairs"""),
    "val_wrong_language": S("""SELECT conv_id, turn, src RLIKE '[éèçê]' AND NOT tgt RLIKE '[éèçê]' AS switched FROM pairs"""),
}

STATEMENTS = SCALARS | TEXTS | PAIR_CHECKS | pairs.STATEMENTS


def _of(table: str, function):
    return lambda spark, sf_dir: function(read(spark, sf_dir, table))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").selectExpr("conv_id", "turn", "text AS src")
    a = c.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 AS turn", "text AS tgt")
    return u.join(a, ["conv_id", "turn"])


#: Sequential algorithms, with no SQL form: Arrow functions over one row or one bounded group.
QUERIES = {
    "txt_pack_batches": _of("documents", algorithms.pack_batches),
    "txt_sentence_align": lambda spark, sf_dir: algorithms.align_sentences(_pairs(spark, sf_dir)),
    "txt_chunk_scan": _of("documents", algorithms.chunk_scan),
    "txt_residual_sweep": _of("documents", algorithms.residual_spans),
    "fn_residual_runs": lambda spark, sf_dir: algorithms.residual_runs(_pairs(spark, sf_dir)),
    "fn_encoding_sniff": _of("documents", algorithms.sniff_encodings),
    "txt_corruption_ops": _of("documents", algorithms.corruptions),
    "win_monotone_chain": _of("events", algorithms.monotone_chain),
    "join_fuzzy_matching": lambda spark, sf_dir: algorithms.typo_matching(_pairs(spark, sf_dir)),
    "scan_html_blocks": _of("pages", algorithms.html_blocks),
    "smp_greedy_cover": _of("events", algorithms.greedy_cover),
    "expansion_fixpoint": _of("documents", algorithms.expand_fixpoint),
}
