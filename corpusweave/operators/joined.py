"""Registered queries of the joins that are brought to equi-joins, with SQL that states all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.operators import scaled_joins as joins
from corpusweave.sources.tables import read

#: Windows of use: each order watches one kind of event for up to an hour of a day, of one user or of all; some pass midnight.
_WINDOWS = """SELECT o_orderkey AS k, {at}(o_orderkey % 5{plus}) AS event_type, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 150 END AS user_id,
    o_orderkey % 30 * 86400 AS day, o_orderkey * 7919 % 86400 AS t0, (o_orderkey * 7919 + o_custkey * 31 % 3600) % 86400 AS t1 FROM orders"""
_KINDS = "'click', 'error', 'purchase', 'signup', 'view'"


def join_interval_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and their value in each window, both ends included; windows without calls give 0."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    w = spark.sql(_WINDOWS.format(at=f"get(array({_KINDS}), CAST", plus=" AS INT)"))
    end = joins.past_midnight(F.col("t0"), F.col("t1"))
    windows = w.select("k", "event_type", "user_id", (F.col("day") + F.col("t0")).alias("low"), (F.col("day") + end).alias("high"))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    events = read(spark, sf_dir, "events").select("event_type", "user_id", "value", seconds.alias("at"))
    used = joins.interval_usage(events, windows, "k", "at", "low", "high", "value", keys=("event_type",), optional=("user_id",))
    calls, total = F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce(F.round("total", 4), F.lit(0.0)).alias("total")
    return windows.select("k").join(used.hint("merge"), "k", "left").select("k", calls, total)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_name").distinct()


def join_fuzzy_lev2(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    return joins.near_strings(names, names, "p_name", "p_name", 2).where("a < b")


def fn_edit_dist_is1(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    return joins.near_strings(names, names, "p_name", "p_name", 1).where("a < b and d = 1").select("a", "b")


def join_regex_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each term of a dictionary: the first three words of every benchmark item, and the words of part names."""
    openings = read(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("w"))
    words = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    places = joins.term_places(read(spark, sf_dir, "documents"), openings.unionByName(words), "doc_id", "text", "w")
    return places.select("doc_id", F.col("term").alias("w")).distinct().groupBy("w").agg(F.count("*").alias("n"))


def join_term_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each term and its rendering (neighbouring words of benchmark openings): turns whose source has the term, and those
    of them whose answer has the rendering."""
    c = read(spark, sf_dir, "conversations")
    turns = c.where("role = 'user'").selectExpr("conv_id", "turn", "text AS src").join(c.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 AS turn", "text AS tgt"), ["conv_id", "turn"])
    turns = turns.withColumn("at", F.struct("conv_id", "turn"))
    opening = F.filter(F.slice(F.split("text", " "), 1, 12), lambda w: w.rlike("^[A-Za-z]+$"))
    terms = read(spark, sf_dir, "benchmark").select(opening.alias("w")).where("size(w) > 1")
    terms = terms.select(F.inline(F.expr("transform(sequence(1, size(w) - 1), i -> struct(w[i - 1] AS term, w[i] AS target))"))).distinct()
    has = lambda side, column: joins.term_places(turns, terms, "at", side, column).select("at", F.col("term").alias(column)).distinct()
    applicable = has("src", "term").join(terms, "term")
    hit = has("tgt", "target").withColumn("hit", F.lit(1))
    return applicable.join(hit, ["at", "target"], "left").groupBy("term", "target").agg(F.count("*").alias("applicable"), F.count("hit").alias("hits"))


def join_gram_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.gram_anchors(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (join_interval_usage, join_fuzzy_lev2, fn_edit_dist_is1, join_regex_dictionary, join_term_consistency, join_gram_anchor)}

_NEAR = """WITH a AS (SELECT DISTINCT p_name AS n FROM part) SELECT x.n AS a, y.n AS b{d} FROM a x JOIN a y ON x.n < y.n WHERE levenshtein(x.n, y.n) {most}"""
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _term_in(text: str, term: str) -> str:
    parts = rf"list_transform(list_filter(regexp_split_to_array({_FOLD.format(term)}, '[~\s]+'), lambda x: x <> ''), lambda x: regexp_escape(x))"
    return rf"regexp_matches({_FOLD.format(text)}, '(^|[^a-z0-9_])' || array_to_string({parts}, '[~\s]+') || '($|[^a-z0-9_])')"


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"
ORACLES = {
    "join_interval_usage": f"""WITH w AS ({_WINDOWS.format(at=f"list_extract([{_KINDS}], CAST", plus=" + 1 AS INT)")}),
x AS (SELECT k, event_type, user_id, day + t0 AS low, day + CASE WHEN t1 < t0 THEN t1 + 86400 ELSE t1 END AS high FROM w),
e AS (SELECT event_type, user_id, value, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - 1704067200 AS at FROM events)
SELECT x.k, count(e.at) AS calls, coalesce(round(sum(e.value), 4), 0) AS total FROM x LEFT JOIN e ON e.event_type = x.event_type AND (x.user_id IS NULL OR x.user_id = e.user_id) AND e.at BETWEEN x.low AND x.high GROUP BY x.k""",
    "join_fuzzy_lev2": _NEAR.format(d=", CAST(levenshtein(x.n, y.n) AS INTEGER) AS d", most="<= 2"),
    "fn_edit_dist_is1": _NEAR.format(d="", most="= 1"),
    "join_regex_dictionary": f"""WITH t AS (SELECT array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS w FROM benchmark UNION SELECT unnest(string_split(p_name, ' ')) FROM part)
SELECT w, count(*) AS n FROM t, documents WHERE {_term_in("text", "w")} GROUP BY w""",
    "join_term_consistency": f"""WITH p AS (SELECT u.text AS src, a.text AS tgt FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
o AS (SELECT list_filter(list_slice(string_split(text, ' '), 1, 12), lambda x: regexp_full_match(x, '[A-Za-z]+')) AS w FROM benchmark),
t AS (SELECT DISTINCT w[i] AS term, w[i + 1] AS target FROM (SELECT w, unnest(range(1, len(w))) AS i FROM o) AS x)
SELECT term, target, count(*) AS applicable, count(*) FILTER (WHERE {_term_in("tgt", "target")}) AS hits FROM t, p WHERE {_term_in("src", "term")} GROUP BY term, target""",
    "join_gram_anchor": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 5], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS p FROM d WHERE len(w) > 5) AS x),
h AS (SELECT item_id, len(w) AS n_words, p, array_to_string(w[p:p + 5], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS p FROM i WHERE len(w) > 5) AS x),
m AS (SELECT doc_id, item_id, n_words, g.p - h.p AS off, h.p AS p FROM g JOIN h USING (gram)),
c AS (SELECT doc_id, item_id, n_words, off, count(DISTINCT p) AS votes, count(DISTINCT q) AS covered FROM (SELECT *, unnest(range(p, p + 6)) AS q FROM m) AS x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY covered DESC, off) AS nth FROM c)
SELECT doc_id, item_id, CAST(off AS INTEGER) AS "offset", votes, covered, n_words FROM r WHERE nth = 1""",
}
