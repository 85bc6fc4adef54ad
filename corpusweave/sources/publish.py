"""Publishing a table whole: a new folder for each version, and a pointer that is swapped by one rename.

Readers follow the pointer, so they see the version before or the one after, whatever fails in between; a version that
wasn't finished is never pointed at.  Folders of old versions stay for readers that have begun; removing them is the caller's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(df: DataFrame, root: str) -> str:
    """Writes ``df`` under ``root`` and points at it; returns the version's name."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    jvm = spark._jvm
    swap, pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/.{version}"), jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    out = _fs(spark, root).create(swap, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(swap.toUri() if swap.toUri().getScheme() else _fs(spark, root).getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(swap, pointer, how)
    return version


def published(spark: SparkSession, root: str) -> str | None:
    """The version that is pointed at; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    if not _fs(spark, root).exists(path):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()[0]


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The published table; an error before the first version."""
    version = published(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/{version}")
