"""Queries stated as SQL: how a statement is bound to tables, and the two dialects.

A statement is written once in Spark SQL.  Where DuckDB names a function otherwise, its text is derived by
the short list below, or given apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from corpusweave.sources.tables import TABLES, register

#: Relations that many queries start from: the ledger's cells, claims and runs as views of ``events``.
VIEWS = {
    "cells": """SELECT event_id AS seq, concat('r', CAST(event_id % 4 AS STRING)) AS run, CAST(event_id % 4 AS BIGINT) AS run_seq,
        user_id AS idc, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'base' ELSE 'alt' END AS arm, event_id % 2 AS variant,
        CASE WHEN value < 20 THEN 'ok' WHEN value < 60 THEN 'warn' WHEN value < 120 THEN 'fail' WHEN value < 160 THEN 'skip' ELSE 'lost' END AS status,
        value, ts, props FROM events""",
    "claims": """SELECT event_id AS seq, user_id AS idc, event_type AS slot, CASE event_id % 3 WHEN 0 THEN 'acquire' WHEN 1 THEN 'release' ELSE 'acquire' END AS op,
        event_id % 11 = 0 AS reap FROM events""",
    "pairs": """SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt FROM conversations u JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
    "frame": """SELECT doc_id AS id, lang AS grp, source AS cls, n_chars, doc_id % 40 AS month, CASE WHEN doc_id % 40 < 10 THEN 'b1' WHEN doc_id % 40 < 20 THEN 'b2'
        WHEN doc_id % 40 < 30 THEN 'b3' ELSE 'b4' END AS band FROM documents""",
    "papers": """SELECT l_orderkey AS paper, l_linenumber AS ord, CAST(l_quantity AS BIGINT) AS words, l_returnflag AS bucket,
        CAST(year(l_shipdate) AS BIGINT) AS yr FROM lineitem""",
}
#: Spark's name and DuckDB's, as patterns on the text of a statement.
DIALECT = (
    (r"\bSTRING\b", "VARCHAR"),
    (r"\bsha2\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*), 256\)", r"sha256(\1)"),
    (r"\bcount_if\(", "countif("),
    (r"\bcollect_list\(", "list("),
    (r"\bRLIKE\b", "~*~"),
    (r"\bpercentile\(", "quantile_cont("),
    (r"\bget_json_object\((\w+(?:\.\w+)?), ", r"json_extract_string(\1, "),
    (r"\bunix_micros\(", "epoch_us("),
)


ROWS = 500_000  # of a dealt table that a task gets


@dataclass(frozen=True)
class Statement:
    """One registered query.  ``duck``: DuckDB's text where it can't be derived; None: derive it."""

    spark: str
    duck: str | None = None
    names: tuple[str, ...] = field(default=())
    #: A table and a key of it: where the table has over ROWS rows for each shuffle partition, it is dealt by the key
    #: into more partitions first, so that the rows that one task sorts don't grow with the table.
    dealt: tuple[str, str] | None = None

    def used(self, text: str) -> list[str]:
        """Views that the text mentions, those that other views need first."""
        words = set(re.findall(r"[a-z_]+", text))
        return [v for v in VIEWS if v in words]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        text = self.spark
        for view in self.used(text):
            text += VIEWS[view]
        register(spark, sf_dir, tuple(t for t in TABLES if re.search(rf"\b{t}\b", text)))
        return spark.sql(self._with_views(self._dealt(spark)))

    def _dealt(self, spark: SparkSession) -> str:
        if not self.dealt:
            return self.spark
        table, key = self.dealt
        parts = -(-spark.table(table).count() // ROWS)  # from the files' footers
        if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
            return self.spark
        used = spark.table(table).columns
        columns = ", ".join(c for c in used if re.search(rf"\b{c}\b", self.spark))
        return re.sub(rf"\bFROM {table}\b", f"FROM (SELECT /*+ REPARTITION({parts}, {key}) */ {columns} FROM {table})", self.spark)

    def oracle(self) -> str:
        text = self.duck or self.spark
        for pattern, to in DIALECT:
            text = re.sub(pattern, to, text)
        text = re.sub(r"(\S+) ~\*~ ('(?:[^']|'')*')", r"regexp_matches(\1, \2)", text)
        out = self._with_views(text)
        for pattern, to in DIALECT[:1]:
            out = re.sub(pattern, to, out)
        return out

    def _with_views(self, text: str) -> str:
        heads = [f"{v} AS ({VIEWS[v]})" for v in self.used(text)]
        if not heads:
            return text
        body = text.strip()
        recursive = body.upper().startswith("WITH RECURSIVE")
        if body.upper().startswith("WITH"):
            body = ", " + re.sub(r"^WITH( RECURSIVE)?\s+", "", body, flags=re.I)
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(heads) + " " + body


def queries(statements: dict[str, Statement]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(s: Statement):
        return lambda spark, sf_dir: s.run(spark, sf_dir)

    return {name: bind(s) for name, s in statements.items()}
