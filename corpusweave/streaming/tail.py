"""A streaming source over growing ledger files: whole lines past a byte offset, each once.

The offset of a file is the byte after its last line end, beside a tag of the file.  A torn last line waits for the batch
in which its end arrives.  A file with another tag (created anew, or its first line changed) and a file that has
shrunk are read from the start again; applying them is idempotent, see ``replay``.

    spark.dataSource.register(LedgerTail)
    spark.readStream.format("ledger_tail").option("path", "/shared/ledger").load()

The folder must be mounted alike on all machines.  Options: ``path``; ``suffix`` of the files' names (.jsonl); ``chunk``,
the bytes that a task reads (32 MB).  A task begins after the first line end in its range and ends with the line that crosses its last byte.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 65_536  # bytes read at once while looking for a line end
HEAD = 4_096  # bytes of the first line that take part in the tag
RAW = "file string, at long, line string, bad_utf8 boolean"


@dataclass
class Piece(InputPartition):
    """Lines of ``name`` that begin in [low, high)."""

    name: str
    tag: str
    low: int
    high: int


def whole_lines_end(path: str, size: int) -> int:
    """Offset after the last line end among the first ``size`` bytes, 0 without one."""
    with open(path, "rb") as f:
        high = size
        while high > 0:
            low = max(0, high - BLOCK)
            f.seek(low)
            if (i := f.read(high - low).rfind(b"\n")) >= 0:
                return low + i + 1
            high = low
    return 0


def tag_of(path: str) -> str:
    """Device, inode and first line of a file: what stays while lines are appended."""
    stat = os.stat(path)
    with open(path, "rb") as f:
        head = f.readline(HEAD)
    return f"{stat.st_dev}:{stat.st_ino}:{hashlib.sha256(head).hexdigest()[:16] if head.endswith(b'\n') or len(head) == HEAD else ''}"


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, chunk: int):
        self.path, self.suffix, self.chunk = path.removeprefix("file://"), suffix, chunk

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{file: [tag, offset]} of the files that are there now."""
        found = {}
        for name in sorted(os.listdir(self.path)):
            if name.endswith(self.suffix) and not name.startswith((".", "_")):
                try:
                    path = os.path.join(self.path, name)
                    tag = tag_of(path)
                    found[name] = [tag, whole_lines_end(path, os.stat(path).st_size)]
                except FileNotFoundError:  # rotated away since it was listed
                    continue
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pieces = []
        for name, (tag, high) in end.items():
            old, at = start.get(name, ["", 0])
            low = at if old == tag and at <= high else 0
            pieces += [Piece(name, tag, x, min(x + self.chunk, high)) for x in range(low, high, self.chunk)]
        return pieces

    def read(self, partition: Piece) -> Iterator[tuple]:
        path = os.path.join(self.path, partition.name)
        try:
            if tag_of(path) != partition.tag:  # replaced after it was planned: the next batch reads it from the start
                return
        except FileNotFoundError:
            return
        with open(path, "rb") as f:
            at = partition.low
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.high and (line := f.readline()):
                raw = line.rstrip(b"\n")
                try:
                    text, bad = raw.decode(), False
                except UnicodeDecodeError:
                    text, bad = raw.decode(errors="replace"), True
                if raw:
                    yield partition.name, at, text, bad
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing to release: the files belong to their writers."""


class LedgerTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_tail"

    def schema(self) -> str:
        return RAW

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("chunk", 32 << 20)))
