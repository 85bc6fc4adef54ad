"""JSON in one form: keys sorted, no white space, characters as they are, at any depth, by Spark's VARIANT.

A VARIANT keeps an object's fields in the order of their names, so writing a parsed text gives equal texts for equal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.sources.tables import read


def canonical_json(text: Column) -> Column:
    """The canonical form; null for a text that isn't JSON, or has a key twice in one object."""
    return F.to_json(F.try_parse_json(text))


def nested_events(events: DataFrame) -> DataFrame:
    """(event_id, raw): each event as nested JSON with blanks, escapes, arrays and its keys in no order."""
    raw = F.format_string(
        '{ "type" : "%s",\n "props": %s , "Ä": {"z": [ {"b": null, "a": true}, [1, 2.5, "\\u00e9\\n\\"%s\\""] ], "y": %s}, "user": %s }',
        F.col("event_type"), F.col("props"), F.col("event_type"), F.col("event_id").cast("string"), F.col("user_id").cast("string"),
    )
    return events.select("event_id", raw.alias("raw"))


def fn_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_events(read(spark, sf_dir, "events")).select("event_id", canonical_json(F.col("raw")).alias("canon"))


QUERIES = {"fn_canonical_json": fn_canonical_json}
ORACLES = {
    "fn_canonical_json": """SELECT event_id, '{"props":{"k":' || json_extract_string(props, '$.k') || '},"type":"' || event_type || '","user":' || user_id || ',"Ä":{"y":' || event_id || ',"z":[{"a":true,"b":null},[1,2.5,"é\\n\\"' || event_type || '\\""]]}}' AS canon FROM events"""
}
