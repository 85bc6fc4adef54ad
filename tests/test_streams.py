"""Streams with offsets and state: appended, torn, shrunk and recreated files, replays, restarts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusweave.sources.tables import read
from corpusweave.streaming import ledger, ledger_queries, state
from corpusweave.streaming.replay import Log
from corpusweave.streaming.tail import LedgerTail, TailReader

LINE = "file string, at long, line string, bad_utf8 boolean"


@pytest.fixture()
def tail(spark, tmp_path):
    """A function that runs one batch over the ledger folder and returns all lines seen so far."""
    spark.dataSource.register(LedgerTail)
    (tmp_path / "ledger").mkdir()

    def run():
        rows = spark.readStream.format("ledger_tail").option("path", str(tmp_path / "ledger")).option("chunk", "64").load()
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["line"] for r in spark.read.schema(LINE).parquet(str(tmp_path / "out")).collect())

    return tmp_path / "ledger", run


def test_append_tear_shrink_recreate_restart(tail):
    folder, run = tail
    a, want = folder / "a.jsonl", []
    lines = [json.dumps({"n": i, "é": "x" * (i % 90)}, ensure_ascii=False) for i in range(40)]
    a.write_text("".join(f"{x}\n" for x in lines[:10]) + lines[10][:7])
    want += lines[:10]
    assert run() == sorted(want)  # the torn line waits
    with a.open("a") as f:
        f.write(lines[10][7:] + "\n\n" + lines[11] + "\n")
    (folder / "b.jsonl").write_text(lines[12] + "\n")
    want += lines[10:13]
    assert run() == sorted(want)
    assert run() == sorted(want)  # nothing new
    a.write_text(lines[0] + "\n")  # shrunk in place, same first line: read from the start
    want += [lines[0]]
    assert run() == sorted(want)
    new = folder / "new"
    new.write_text("".join(f"{x}\n" for x in lines[20:35]))  # another file under the same name, longer than the old offset
    os.replace(new, a)
    want += lines[20:35]
    assert run() == sorted(want)
    (folder / "b.jsonl").unlink()
    (folder / "c.jsonl").write_bytes(b'{"n": 99}\nbroken \xff\n')
    want += ['{"n": 99}', "broken �"]
    assert run() == sorted(want)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 10_000])
def test_chunks_cut_at_line_ends(tmp_path, chunk):
    texts = ["", "a", "bb", "", "c" * 50, "é" * 9, "last"]
    (tmp_path / "x.jsonl").write_text("\n".join(texts) + "\ntorn")
    reader = TailReader(str(tmp_path), ".jsonl", chunk)
    end = reader.latestOffset()
    got = [r for p in reader.partitions({}, end) for r in reader.read(p)]
    assert [r[2] for r in got] == [t for t in texts if t]
    data = (tmp_path / "x.jsonl").read_bytes()
    assert all(data[at:].startswith(text.encode()) for _, at, text, _ in got)
    assert reader.partitions(end, end) == [] and reader.latestOffset() == end


def batches(spark, sf_dir, folder, n=6):
    """The ledger in n files, in order, and a function that gives it as a stream of one file a batch."""
    events = ledger.events_of(read(spark, sf_dir, "events")).persist()
    top = events.count()
    for i in range(n):
        write(events.where(f"arrival >= {i * top // n} and arrival < {(i + 1) * top // n}"), folder, i)
    return events


def write(df, folder, i):
    df.coalesce(1).write.mode("append").parquet(str(folder / f"part{i}"))


def stream(spark, events, folder):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_state_after_many_batches_and_a_restart(spark, sf_dir, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    events = ledger.events_of(read(spark, sf_dir, "events")).persist()
    top = events.count()
    for i in range(5):  # each round restarts both streams
        write(events.where(f"arrival >= {i * top // 5} and arrival < {(i + 1) * top // 5}"), folder, i)
        for name, changes in (("latest", state.latest_changes), ("slots", lambda e: state.slot_changes(ledger.claims_of(e)))):
            state.follow(changes(stream(spark, events, folder)), str(tmp_path / name))
    live = state.current(spark, str(tmp_path / "latest"), "latest").select("key.idc", "key.stage", "value.value", "value.arrival")
    assert sorted(live.collect()) == sorted(ledger.latest_state(events).select("idc", "stage", "value", "arrival").collect())
    slots = state.current(spark, str(tmp_path / "slots"), "slots", mapped=True).select("key.idc", "user_map_key.slot", "user_map_value.at")
    want = ledger.open_slots(events)
    assert sorted(map(tuple, slots.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_replays_and_conflicts_over_restarts(spark, sf_dir, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    events = batches(spark, sf_dir, folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    first = Log(spark, str(tmp_path / "log"), schema)
    first.follow(stream(spark, events, folder), str(tmp_path / "ck"))
    applied, clash = ledger.first_of_key(events)
    want = sorted(map(str, applied.collect())), sorted(map(str, clash.collect()))
    assert want[1] and (sorted(map(str, first.applied().collect())), sorted(map(str, first.quarantined().collect()))) == want
    for i in range(3):  # all again, in other batches, after a restart
        write(events.where(f"arrival % 3 = {i}"), folder, f"again{i}")
    again = Log(spark, str(tmp_path / "log"), schema)
    again.follow(stream(spark, events, folder), str(tmp_path / "ck"))
    assert (sorted(map(str, again.applied().collect())), sorted(map(str, again.quarantined().collect()))) == want
    again.apply(events.where("arrival < 50"), 0)  # a batch that runs again
    assert sorted(map(str, again.applied().where("arrival < 50").collect())) == sorted(map(str, applied.where("arrival < 50").collect()))


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    schema = "run string, seq long, arrival long, sha string"
    rows = spark.range(40_000).select(F.lit("r0").alias("run"), F.col("id").alias("seq"), F.col("id").alias("arrival"), F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    log = Log(spark, str(tmp_path / "log"), schema)
    for i in range(4):
        log.apply(rows.where(f"seq div 10000 = {i}"), i)
    log.apply(rows.where("seq >= 39990"), 4)
    log.apply(rows, 5)
    assert log.applied().count() == 40_000 and log.quarantined().count() == 0
    assert log.read_bytes[4] * 5 < log.read_bytes[5]  # ten replays look up one bucket of twenty


def test_a_bucket_is_one_file_of_a_batch(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).select(F.lit("r0").alias("run"), (F.col("id") * 7919 % 20_000).alias("seq"), F.col("id").alias("arrival"), F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    Log(spark, str(tmp_path / "log"), "run string, seq long, arrival long, sha string").apply(rows, 0)
    folders = list((tmp_path / "log" / "applied").glob("bucket=*/batch=0"))
    assert 1 < len(folders) <= 10 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)


@pytest.mark.parametrize(("query", "want"), [("st_slot_stream", ledger.open_slots), ("st_latest_state_stream", ledger.latest_state)])
def test_a_part_of_many_files_is_one_batch_in_the_order_of_the_ledger(spark, sf_dir, tmp_path, monkeypatch, query, want):
    made, events = iter(range(10)), read(spark, sf_dir, "events")
    events.repartition(6).write.parquet(f"{tmp_path}/sf/events.parquet")
    monkeypatch.setattr(ledger_queries, "scratch", lambda _: f"file://{tmp_path}/{next(made)}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = ledger_queries.QUERIES[query](spark, f"{tmp_path}/sf").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list(tmp_path.glob("*/part=0/*.parquet"))) > 1
    assert len([x for x in tmp_path.glob("*/commits/*") if not x.name.startswith(".")]) == 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, want(ledger.events_of(events)).collect()))
