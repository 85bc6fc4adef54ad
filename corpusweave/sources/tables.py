"""Reading tables, guarding their schemas and registering them for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class SchemaDrift(ValueError):
    """A table lacks columns that a query needs."""


def read(spark: SparkSession, sf_dir: str, name: str, need: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return guard(df, need, name)


def guard(df: DataFrame, need: tuple[str, ...], name: str = "table") -> DataFrame:
    """``df`` itself, or SchemaDrift naming the missing columns, before any plan is built on it."""
    if missing := [c for c in need if c not in df.columns]:
        raise SchemaDrift(f"schema_drift: {name} lacks {', '.join(missing)}")
    return df


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(name)
