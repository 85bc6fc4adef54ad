"""Scans, sinks, import steps and composite reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions import algorithms
from corpusweave.plans.sql import Statement as S
from corpusweave.sources import files, publish
from corpusweave.sources.tables import guard, read

STATEMENTS = {
    "scan_parquet_project": S("""SELECT doc_id, upper(lang) AS lang, n_chars / 1000e0 AS kchars FROM documents"""),
    "scan_rowgroup_pruned": S("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderstatus = 'F'"""),
    "scan_semi_by_ids": S("""SELECT d.doc_id, d.lang, d.n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)"""),
    "scan_csv_union_channels": S("""SELECT 'supplier' AS channel, s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY'"""),
    "scan_lookup_tsv": S("""SELECT p_partkey, concat_ws('|', p_name, p_brand, CAST(p_size AS STRING)) AS row_text FROM part WHERE p_name IS NOT NULL"""),
    "scan_sealed_plus_hot": S("""SELECT event_id, event_type, 'sealed' AS src FROM events WHERE event_id < 8000 UNION ALL SELECT event_id, event_type, 'hot' FROM events WHERE event_id >= 8000"""),
    "sink_blob_offload": S("""SELECT doc_id, CASE WHEN octet_length(CAST(text AS BINARY)) > 4096 THEN sha2(text, 256) ELSE 'inline' END AS blob FROM documents""",
        """SELECT doc_id, CASE WHEN strlen(text) > 4096 THEN sha256(text) ELSE 'inline' END AS blob FROM documents"""),
    "sink_share_bundle": S("""SELECT source, count(*) AS files, sha2(CAST(sum(n_chars) AS STRING), 256) AS manifest FROM documents GROUP BY source""",
        """SELECT source, count(*) AS files, sha256(CAST(CAST(sum(n_chars) AS BIGINT) AS VARCHAR)) AS manifest FROM documents GROUP BY source"""),
    "imp_normalise_union": S(
        """SELECT user_id AS id, event_type AS stage, 'a' AS shape FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id, lower(event_type), 'b' FROM events WHERE event_id % 3 = 1 UNION ALL SELECT coalesce(user_id, -1), coalesce(event_type, '?'), 'c' FROM events WHERE event_id % 3 = 2"""
    ),
    "imp_conservative_order": S(
        """SELECT idc, stage, CASE WHEN stage = 'purchase' THEN max_by(status, CASE WHEN status = 'ok' THEN 1000000 ELSE 0 END + seq) ELSE max_by(status, CASE WHEN status = 'ok' THEN 0 ELSE 1000000 END + seq) END AS last_status FROM cells GROUP BY idc, stage"""
    ),
    "imp_known_filter": S("""SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events k WHERE k.event_id < (SELECT max(event_id) / 2e0 FROM events) AND sha2(k.event_type || CAST(k.value AS STRING), 256) = sha2(e.event_type || CAST(e.value AS STRING), 256)) AND event_id >= (SELECT max(event_id) / 2e0 FROM events)"""),
    "imp_redact": S(
        """SELECT doc_id, regexp_replace(regexp_replace(text, '[0-9A-Za-z._]+@[0-9A-Za-z.]+', '<mail>'), 'token = "[0-9a-fA-F]+"', 'token = "<secret>"') AS body FROM documents""",
        """SELECT doc_id, regexp_replace(regexp_replace(text, '[0-9A-Za-z._]+@[0-9A-Za-z.]+', '<mail>', 'g'), 'token = "[0-9a-fA-F]+"', 'token = "<secret>"', 'g') AS body FROM documents""",
    ),
    "imp_status_map": S("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'quarantine' END AS status FROM orders"""),
    "cas_gc_candidates": S("""SELECT sha, first_id FROM (SELECT sha2(text, 256) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1) AS x WHERE n = 1 AND first_id < (SELECT max(doc_id) / 2e0 FROM documents)"""),
    "never_passed_clusters": S(
        """WITH t AS (SELECT idc, stage, max(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS done, max_by(status, seq) AS last_status FROM cells WHERE value > 15 GROUP BY idc, stage) SELECT stage, last_status, count(*) AS n FROM t WHERE done = 0 GROUP BY stage, last_status"""
    ),
    "verb_rundiff": S(
        # each run against the next
        """WITH s AS (SELECT run_seq, idc, stage, max_by(status, seq) AS s FROM cells GROUP BY run_seq, idc, stage),
        a AS (SELECT run_seq AS pair, idc, stage, s FROM s WHERE run_seq < (SELECT max(run_seq) FROM s)), b AS (SELECT run_seq - 1 AS pair, idc, stage, s FROM s WHERE run_seq > (SELECT min(run_seq) FROM s))
        SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.stage, b.stage) AS stage, count(*) FILTER (WHERE a.s = b.s) AS same, count(*) FILTER (WHERE a.s <> b.s) AS changed, count(*) FILTER (WHERE a.s IS NULL) AS added, count(*) FILTER (WHERE b.s IS NULL) AS gone FROM a FULL OUTER JOIN b ON a.pair = b.pair AND a.idc = b.idc AND a.stage = b.stage GROUP BY 1, 2"""
    ),
    "verb_triage": S("""SELECT run, stage, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok, count(DISTINCT CASE WHEN status IN ('fail', 'lost') THEN idc END) AS bad_ids FROM cells GROUP BY run, stage"""),
    "verb_booster_report": S("""SELECT source, count(*) AS n, round(avg(CAST(l.quality AS DOUBLE)), 6) AS quality, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source"""),
    "verb_dossier": S(
        """SELECT idc, run, stage, count(*) AS attempts, max_by(status, seq) AS last_status, coalesce(min(seq) FILTER (WHERE status IN ('fail', 'lost')), -1) AS first_bad, round(sum(value), 2) AS value FROM cells GROUP BY idc, run, stage"""
    ),
    "st_sealed_check": S("""SELECT run, max(seq) AS watermark, count(*) AS n, max(seq) >= 9990 AS covered FROM cells GROUP BY run"""),
}


def scan_schema_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = guard(read(spark, sf_dir, "documents"), ("doc_id", "text", "lang", "source", "n_chars"), "documents")
    return spark.createDataFrame(list(df.dtypes), "column string, type string")


def scan_jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_lines(read(spark, sf_dir, "events").select("event_id", F.col("props").alias("line")), "k INT")


def scan_multifile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_members(read(spark, sf_dir, "documents"))


def scan_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.classify_blobs(read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("blob")))


def scan_footer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: rows and the bounds of one column, by Spark's own metadata columns."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.write_and_read(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "parquet")


def sink_report_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = read(spark, sf_dir, "events").groupBy("event_type").count().orderBy("event_type")
    line = F.concat(F.lit("| "), "event_type", F.lit(" | "), F.col("count").cast("string"), F.lit(" |"))
    return tally.select(F.col("event_type").alias("k"), line.alias("line"))


def scan_bib_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", "concat('@article{k', doc_id % 90, ', title = {', source, ' {x}}, year = 2001}\\n@string{s = {y}}\\n@book{k', doc_id % 90, ', a = {b}}') AS text")
    return algorithms.bib_entries(d)


def scan_docx_epub_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", "text")
    return files.zipped_units(files.as_docx(d))


def scan_api_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(files.PagedSource)
    return spark.read.format("corpusweave_paged").option("total", "1050").option("size", "100").load()


def sink_append_fsync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two validated batches appended to one table."""
    e, path = read(spark, sf_dir, "events").select("event_id", "event_type"), files.scratch(spark)
    for batch in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        batch.where("event_type is not null").write.mode("append").parquet(path)
    return spark.read.schema(e.schema).parquet(path)


def sink_atomic_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published twice; readers follow a pointer that one rename swaps."""
    p, path = read(spark, sf_dir, "part").select("p_partkey", "p_name"), files.scratch(spark)
    for version in (p.limit(10), p):
        publish.publish(version, path)
    return publish.read_published(spark, path)


QUERIES = {
    f.__name__: f
    for f in (scan_schema_guard, scan_jsonl_tolerant, scan_multifile_split, scan_archive_members, scan_footer_catalog, sink_parquet, sink_report_md, scan_bib_entries, scan_docx_epub_units, scan_api_paged, sink_append_fsync, sink_atomic_publish)
}
ORACLES = {
    "scan_api_paged": "SELECT CAST(range AS BIGINT) AS id, CAST(floor(range / 100) AS INTEGER) AS page FROM range(1050)",
    "sink_append_fsync": "SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL",
    "sink_atomic_publish": "SELECT p_partkey, p_name FROM part",
    "scan_jsonl_tolerant": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, false AS bad FROM events",
    "sink_parquet": "SELECT doc_id, lang, n_chars FROM documents",
    "sink_report_md": "SELECT event_type AS k, '| ' || event_type || ' | ' || CAST(count(*) AS VARCHAR) || ' |' AS line FROM events GROUP BY event_type",
    "scan_multifile_split": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(length(body) AS BIGINT) AS n_chars FROM l WHERE length(body) > 0",
}
