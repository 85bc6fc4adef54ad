"""Projections that keep their state between micro-batches, by key, in the state store.

Batches come in the order of the ledger; within one, rows may come in any order.  Both projections hold only what is
current: a released or reaped slot leaves the state.  ``current`` reads a stream's state from its checkpoint, so a rebuilt
projection can be compared with a live one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOT_CHANGE = "idc long, slot string, at long, open boolean"
LATEST = "idc long, stage string, value double, arrival long"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Within it, streams start with the state store that keyed map state needs."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def follow(changes: DataFrame, checkpoint: str) -> None:
    """Runs a stream of changes to the present end of its source; the state stays in the checkpoint."""
    with keyed_store(changes.sparkSession):
        changes.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class LatestState(StatefulProcessor):
    """One value of state for each (idc, stage): the value that arrived last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "value double, arrival long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.latest.get() if self.latest.exists() else None
        changed = False
        for part in rows:
            at = part["arrival"].to_numpy().argmax()
            value, arrival = part["value"].iloc[at], int(part["arrival"].iloc[at])
            if best is None or arrival > best[1]:
                best, changed = (None if pd.isna(value) else float(value), arrival), True
        if changed:
            self.latest.update(best)
            yield pd.DataFrame({"idc": [key[0]], "stage": [key[1]], "value": [best[0]], "arrival": [best[1]]})

    def close(self) -> None:
        pass


class OpenSlots(StatefulProcessor):
    """A map of state for each idc: its open slots and when they were acquired.

    A release removes its slot, a reap all slots of the key that were acquired until then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last: dict[str, tuple[int, str]] = {}  # the last operation of each slot in this batch
        reaped = -1
        for part in rows:
            for slot, op, at, reap in part[["slot", "op", "at", "reap"]].itertuples(index=False):
                last[slot] = max(last.get(slot, (-1, "")), (int(at), op))
                reaped = max(reaped, int(at) if reap else -1)
        changes = []
        if reaped >= 0:
            for (slot,), (at,) in list(self.slots.iterator()):
                if at <= reaped:
                    self.slots.removeKey((slot,))
                    changes.append((slot, at, False))
        for slot, (at, op) in last.items():
            if op == "acquire" and at > reaped:
                self.slots.updateValue((slot,), (at,))
                changes.append((slot, at, True))
            elif self.slots.containsKey((slot,)):
                self.slots.removeKey((slot,))
                changes.append((slot, at, False))
        if changes:
            yield pd.DataFrame([(key[0], *c) for c in changes], columns=["idc", "slot", "at", "open"])

    def close(self) -> None:
        pass


def latest_changes(events: DataFrame) -> DataFrame:
    """Changes of the latest value of each (idc, stage) of a stream of ledger events."""
    return events.select("idc", "stage", "value", "arrival").groupBy("idc", "stage").transformWithStateInPandas(LatestState(), LATEST, "Update", "None")


def slot_changes(claims: DataFrame) -> DataFrame:
    """Slots that open and close in a stream of claims (idc, slot, op, at, reap)."""
    return claims.select("idc", "slot", "op", "at", "reap").groupBy("idc").transformWithStateInPandas(OpenSlots(), SLOT_CHANGE, "Update", "None")


def current(spark: SparkSession, checkpoint: str, name: str, mapped: bool = False) -> DataFrame:
    """What the state ``name`` of a stopped stream holds: key and value, for a map also user_map_key and user_map_value."""
    reader = spark.read.format("statestore").option("stateVarName", name)
    return (reader.option("flattenCollectionTypes", "true") if mapped else reader).load(checkpoint)
