"""Registered queries of the streaming ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.sources.files import parse_lines, scratch
from corpusweave.sources.tables import read
from corpusweave.streaming import ledger, state
from corpusweave.streaming.replay import Log
from corpusweave.streaming.tail import LedgerTail


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "events")
    folder = scratch(spark)
    raw.repartition(3, "event_id").write.parquet(folder)
    return ledger.streamed(spark, raw, folder)


def _in_order(spark: SparkSession, sf_dir: str, follow: Callable[[DataFrame], None], again: bool = False) -> None:
    """Gives the ledger to ``follow`` as a stream that grows by three parts, in the order of their events, and by all once more if ``again``.

    A part is followed to its end before the next is written, as one batch of however many files: files of one
    write have no order of their own, and batches as small as files would grow in number with the input.
    """
    events = ledger.events_of(read(spark, sf_dir, "events"))
    folder = scratch(spark)
    cuts = events.agg(F.percentile_approx("arrival", [1 / 3, 2 / 3]).alias("c")).first()["c"] or [0, 0]
    part = (F.col("arrival") > cuts[0]).cast("int") + (F.col("arrival") > cuts[1]).cast("int")
    for i in range(6 if again else 3):
        events.where(part == i % 3).write.parquet(f"{folder}/part={i}")
        follow(spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(folder))


def st_tail_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and read by byte offsets; lines that aren't JSON would be left out here."""
    raw = read(spark, sf_dir, "events")
    folder, table = scratch(spark), scratch(spark)
    raw.select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    spark.dataSource.register(LedgerTail)
    lines = spark.readStream.format("ledger_tail").option("path", folder).option("suffix", ".txt").option("chunk", 1 << 20).load()
    lines.writeStream.format("parquet").option("path", table).option("checkpointLocation", f"{table}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema.fields)
    parsed = parse_lines(spark.read.schema(lines.schema).parquet(table).select("line"), schema).where("not bad").drop("bad")
    return ledger.events_of(parsed).groupBy("run").agg(F.count("*").alias("n"), F.max("arrival").alias("watermark"))


def st_replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events sent twice, applied or refused once."""
    root = scratch(spark)
    schema = ledger.events_of(read(spark, sf_dir, "events")).schema
    log = Log(spark, root, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields))
    _in_order(spark, sf_dir, lambda stream: log.follow(stream, f"{root}-checkpoint"), again=True)
    return log.applied().unionByName(log.quarantined()).groupBy("stage").agg(F.count("*").alias("n"))


def st_latest_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint = scratch(spark)
    _in_order(spark, sf_dir, lambda stream: state.follow(state.latest_changes(stream), checkpoint))
    return state.current(spark, checkpoint, "latest").select("key.idc", "key.stage", "value.value", "value.arrival")


def st_slot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint = scratch(spark)
    _in_order(spark, sf_dir, lambda stream: state.follow(state.slot_changes(ledger.claims_of(stream)), checkpoint))
    return state.current(spark, checkpoint, "slots", mapped=True).select("key.idc", "user_map_key.slot", "user_map_value.at")


def st_conflict_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_of_key(ledger.events_of(read(spark, sf_dir, "events")))[1].select("run", "seq", "arrival", "sha")


def st_rebuild_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which the streamed and the rebuilt projection differ: none."""
    live = ledger.latest_state(ledger.first_of_key(_streamed(spark, sf_dir))[0])
    rebuilt = ledger.latest_state(ledger.first_of_key(ledger.events_of(read(spark, sf_dir, "events")))[0])
    n = live.exceptAll(rebuilt).unionByName(rebuilt.exceptAll(live)).agg(F.count("*").alias("differing"))
    return n.withColumn("equal", F.col("differing") == 0)


def st_type_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger.events_of(read(spark, sf_dir, "events"))
    cells = e.where("stage in ('click', 'view')").select(F.lit("cells").alias("target"), "idc", "arrival")
    claims = e.where("stage = 'signup'").select(F.lit("claims").alias("target"), "idc", "arrival")
    notes = e.where("stage = 'error'").select(F.lit("notes").alias("target"), "idc", "arrival")
    return cells.unionByName(claims).unionByName(notes).groupBy("target").agg(F.count("*").alias("n"), F.max("arrival").alias("last"))


def st_latest_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_state(ledger.events_of(read(spark, sf_dir, "events")))


def st_slot_acquire_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.open_slots(ledger.events_of(read(spark, sf_dir, "events")))


def st_publish_replay_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of what came before 7000, then what is live after the last replayed, without a repeat."""
    e = ledger.events_of(read(spark, sf_dir, "events")).select("arrival", "idc")
    replay, live = e.where("arrival < 7000"), e.where("arrival >= 6900")
    last = replay.agg(F.max("arrival").alias("last"))
    return replay.unionByName(live.crossJoin(F.broadcast(last)).where("arrival > last").drop("last"))


def st_rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "30 minutes")
    return read(spark, sf_dir, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "n")


def st_seal_rotate_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 2048 events with their hash: what sealing would write and later verify."""
    e = ledger.events_of(read(spark, sf_dir, "events"))
    return e.groupBy(F.floor(F.col("arrival") / 2048).alias("segment")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha")), ""), 256).alias("sha"))


QUERIES = {
    f.__name__: f
    for f in (st_tail_ingest, st_replay_idempotent, st_conflict_quarantine, st_rebuild_equivalence, st_type_projection, st_latest_state_upsert, st_slot_acquire_release, st_latest_state_stream, st_slot_stream, st_publish_replay_live, st_rolling_rate, st_seal_rotate_gc)
}
_E = """WITH e AS (SELECT 'r' || CAST(event_id % 4 AS VARCHAR) AS run, event_id - CASE WHEN event_id % 97 = 5 THEN 4 ELSE 0 END AS seq, event_id AS arrival, user_id AS idc, event_type AS stage, value, event_type || '|' || user_id || '|' || value || '|' || props AS payload FROM events)"""
ORACLES = {
    "st_tail_ingest": f"{_E} SELECT run, count(*) AS n, max(arrival) AS watermark FROM e GROUP BY run",
    "st_replay_idempotent": f"{_E} SELECT stage, count(*) AS n FROM (SELECT DISTINCT run, seq, stage, payload FROM e) GROUP BY stage",
    "st_rebuild_equivalence": "SELECT CAST(0 AS BIGINT) AS differing, true AS equal",
    "st_type_projection": f"{_E} SELECT CASE WHEN stage IN ('click', 'view') THEN 'cells' WHEN stage = 'signup' THEN 'claims' ELSE 'notes' END AS target, count(*) AS n, max(arrival) AS last FROM e WHERE stage IN ('click', 'view', 'signup', 'error') GROUP BY 1",
    "st_latest_state_upsert": f"{_E} SELECT idc, stage, max_by(value, arrival) AS value, max(arrival) AS arrival FROM e GROUP BY idc, stage",
    "st_slot_acquire_release": f"{_E}, m AS (SELECT *, CASE WHEN seq % 3 = 1 THEN 'release' ELSE 'acquire' END AS op, CASE WHEN seq % 11 = 0 THEN arrival END AS reap FROM e), b AS (SELECT idc, max(reap) AS reaped FROM m GROUP BY idc), l AS (SELECT idc, stage AS slot, max_by(op, arrival) AS op, max(arrival) AS at FROM m GROUP BY idc, stage) SELECT l.idc, l.slot, l.at FROM l JOIN b ON b.idc = l.idc WHERE l.op = 'acquire' AND l.at > coalesce(b.reaped, -1)",
    "st_publish_replay_live": "SELECT event_id AS arrival, user_id AS idc FROM events",
    "st_rolling_rate": "SELECT CAST(floor(epoch_us(ts) / 1000000 / 1800) AS BIGINT) * 1800 AS start, count(*) AS n FROM events GROUP BY 1",
}
ORACLES["st_latest_state_stream"] = ORACLES["st_latest_state_upsert"]
ORACLES["st_slot_stream"] = ORACLES["st_slot_acquire_release"]
ORACLES["st_conflict_quarantine"] = f"""{_E}, n AS (SELECT *, row_number() OVER w AS nth, first_value(payload) OVER w AS kept FROM e WINDOW w AS (PARTITION BY run, seq ORDER BY arrival))
SELECT run, seq, arrival, sha256(payload) AS sha FROM n WHERE nth > 1 AND payload <> kept"""
