"""Rows that an author's code emits for a group of events, as a table function over a partitioned table.

``author_rows`` makes the function from a class with ``take(row)``, a generator of (metric, value); one object serves one group and
sees its rows in order, so a group of any size is streamed and state is what the object keeps.  What it raises becomes a row
of its own, (``exception``, null, message), and the group goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from corpusweave.sources.tables import read

EMITTED = "key bigint, seq bigint, metric string, value double, error string"


def author_rows(events: DataFrame, author: type, key: str, seq: str) -> DataFrame:
    """EMITTED rows of ``author`` for each group of ``key``, taken in the order of ``seq``; null keys are a group of their own."""

    class Authored:
        def __init__(self):
            self.author = author()

        def eval(self, row: Row) -> Iterator[tuple]:
            at = (row[key], row[seq])
            try:
                for metric, value in self.author.take(row):
                    yield (*at, metric, None if value is None else float(value), None)
            except Exception as e:
                yield (*at, "exception", None, f"{type(e).__name__}: {e}")

    return udtf(Authored, returnType=EMITTED)(events.asTable().partitionBy(key).orderBy(seq))


class Spending:
    """Steps of one user: clicks count, purchases give their value and the sum until then, small errors can't be read."""

    def __init__(self):
        self.clicks, self.total = 0, 0.0

    def take(self, row: Row) -> Iterator[tuple]:
        if row.event_type == "click":
            self.clicks += 1
            yield "clicks", self.clicks
        elif row.event_type == "purchase":
            self.total += row.value
            yield "value", row.value
            yield "spent", round(self.total, 2)
        elif row.event_type == "error":
            yield "seen", row.value
            if row.value < 10:
                raise ValueError(f"value of {row.event_id} is too small")


def author_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_rows(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), Spending, "user_id", "event_id")


QUERIES = {"author_rows": author_rows_query}
ORACLES = {
    "author_rows": """WITH e AS (SELECT user_id AS key, event_id AS seq, event_type AS t, value FROM events)
SELECT key, seq, 'clicks' AS metric, CAST(count(*) OVER w AS DOUBLE) AS value, NULL AS error FROM e WHERE t = 'click' WINDOW w AS (PARTITION BY key ORDER BY seq)
UNION ALL SELECT key, seq, 'value', value, NULL FROM e WHERE t = 'purchase'
UNION ALL SELECT key, seq, 'spent', round(sum(CAST(value AS DECIMAL(18, 2))) OVER w, 2), NULL FROM e WHERE t = 'purchase' WINDOW w AS (PARTITION BY key ORDER BY seq)
UNION ALL SELECT key, seq, 'seen', value, NULL FROM e WHERE t = 'error'
UNION ALL SELECT key, seq, 'exception', NULL, 'ValueError: value of ' || seq || ' is too small' FROM e WHERE t = 'error' AND value < 10""",
}
