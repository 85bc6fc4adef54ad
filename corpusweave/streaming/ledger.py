"""The event ledger as a stream: the same functions serve batches and Structured Streaming.

State lives in tables, so a replay of events that were applied before changes nothing: payload hashes that are
known are skipped, and a key that comes with another payload goes to quarantine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.sources.files import scratch

KEY = ("run", "seq")


def events_of(raw: DataFrame) -> DataFrame:
    """Ledger events from the ``events`` table: key, payload hash, type and state columns."""
    sha = F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.col("value").cast("string"), "props"), 256)
    return raw.select(
        F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")).alias("run"),
        (F.col("event_id") - F.when(F.col("event_id") % 97 == 5, 4).otherwise(0)).alias("seq"),
        F.col("event_id").alias("arrival"),
        F.col("user_id").alias("idc"),
        F.col("event_type").alias("stage"),
        "value",
        sha.alias("sha"),
    )


def first_of_key(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, quarantined): of each key the first payload to arrive; later other payloads are quarantined,
    later equal ones are replays and vanish."""
    w = Window.partitionBy(*KEY).orderBy("arrival")
    marked = events.withColumns({"nth": F.row_number().over(w), "first_sha": F.first("sha").over(w)})
    return marked.where("nth = 1").drop("nth", "first_sha"), marked.where("nth > 1 and sha <> first_sha").drop("nth", "first_sha")


def latest_state(applied: DataFrame) -> DataFrame:
    return applied.groupBy("idc", "stage").agg(F.max_by("value", "arrival").alias("value"), F.max("arrival").alias("arrival"))


def claims_of(applied: DataFrame) -> DataFrame:
    """Claims (idc, slot, op, at, reap) of ledger events; a row with ``reap`` also clears what its owner held until then."""
    op = F.when(F.col("seq") % 3 == 1, "release").otherwise("acquire")
    return applied.select("idc", F.col("stage").alias("slot"), op.alias("op"), F.col("arrival").alias("at"), (F.col("seq") % 11 == 0).alias("reap"))


def open_slots(applied: DataFrame) -> DataFrame:
    """Slots whose last operation acquires them and that no later reap of their owner cleared."""
    claims = claims_of(applied)
    barrier = claims.groupBy("idc").agg(F.max(F.when(F.col("reap"), F.col("at"))).alias("reaped"))
    last = claims.groupBy("idc", "slot").agg(F.max_by("op", "at").alias("op"), F.max("at").alias("at"))
    return last.join(barrier, "idc").where("op = 'acquire' and at > coalesce(reaped, -1)").select("idc", "slot", "at")


def ingest(spark: SparkSession, source: str, schema, table: str, each: Callable[[DataFrame], DataFrame]) -> None:
    """Reads new files of ``source`` once, to the end, and appends ``each`` batch's result to ``table``.

    The checkpoint holds what was read; a batch writes to a folder of its own number, so a batch that runs again
    after a failure replaces its output instead of doubling it."""

    def save(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{table}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def streamed(spark: SparkSession, raw: DataFrame, folder: str) -> DataFrame:
    """All of ``folder`` ingested as a stream, read back as one table."""
    table = scratch(spark)
    ingest(spark, folder, raw.schema, table, events_of)
    return spark.read.parquet(table).drop("batch")
