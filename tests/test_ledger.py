"""Edge rows of the ledger: replays, conflicts, torn lines, nulls."""

import pytest

from corpusweave.sources import files
from corpusweave.sources.tables import SchemaDrift, guard
from corpusweave.streaming import ledger

COLUMNS = "run string, seq long, arrival long, idc long, stage string, value double, sha string"


def test_first_payload_stays_and_others_are_quarantined(spark):
    rows = [("r0", 1, 1, 7, "a", 1.0, "x"), ("r0", 1, 2, 7, "a", 1.0, "x"), ("r0", 1, 3, 7, "a", 2.0, "y"), ("r1", 1, 4, 7, "a", 3.0, "z")]
    kept, bad = ledger.first_of_key(spark.createDataFrame(rows, COLUMNS))
    assert sorted(r["arrival"] for r in kept.collect()) == [1, 4]
    assert [r["arrival"] for r in bad.collect()] == [3]


def test_empty_ledger(spark):
    kept, bad = ledger.first_of_key(spark.createDataFrame([], COLUMNS))
    assert kept.count() == bad.count() == ledger.latest_state(kept).count() == ledger.open_slots(kept).count() == 0


def test_a_second_stream_reads_nothing_again(spark, tmp_path, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw.repartition(2).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ledger.ingest(spark, f"{tmp_path}/in", raw.schema, f"{tmp_path}/out", ledger.events_of)
    assert spark.read.parquet(f"{tmp_path}/out").count() == raw.count()


def test_torn_lines_are_counted_not_fatal(spark):
    got = files.parse_lines(spark.createDataFrame([(1, '{"k": 3}'), (2, '{"k": '), (3, None)], "id long, line string"), "k INT")
    assert sorted((r["id"], r["k"], r["bad"]) for r in got.collect()) == [(1, 3, False), (2, None, True), (3, None, True)]


def test_schema_guard_names_what_is_missing(spark):
    with pytest.raises(SchemaDrift, match="lacks b"):
        guard(spark.range(1), ("id", "b"))
