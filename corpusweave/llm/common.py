"""What several training-data operators share: staging, key ranges, graph components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session has none, a temporary folder is made and set, if all runs on this machine; on a cluster
    that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="corpusweave-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        at = f"file://{_OWN[0]}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/corpusweave/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages before the table.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Removes staged tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for file in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_RESIDENT: dict = {}


def resident(key: tuple, make: Callable):
    """What a Python worker keeps from one task to the next, made where absent: one object, so that the stages of
    a long application don't add up in a worker's memory."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def give_back() -> None:
    """Returns what a partition freed, but Arrow and the C library still hold, to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs hand at most ``rows`` rows at a time to Python, which bounds the memory of both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as ``df`` needs not to have it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_splits(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values of the integer column ``key`` that cut it into even ranges.

    Each is a value that occurs; a column of another type is an error.  One pass over that column alone; the size is ``parts``, whatever the input.
    """
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be an integer column, not {df.schema[key].dataType.simpleString()}")
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(F.col(key), at, 100 * parts).alias("s")).first()["s"]
    return sorted(set(got or []))


def range_of(key: Column, splits: list[int]) -> Column:
    """Number of the range that ``key`` lies in: the count of splits not above it; null lies in 0.

    A binary search over the splits, so the cost grows with the logarithm of their number.
    """
    if not splits:
        return F.lit(0)
    n = len(splits)
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    values = F.array(*[F.lit(s).cast("bigint") for s in splits])
    search = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda lo, step: F.when((lo + step <= n) & (F.try_element_at(values, F.least(lo + step, F.lit(n))) <= key), lo + step).otherwise(lo),
    )
    return F.when(key.isNull(), F.lit(0)).otherwise(search)


def words_ascii_space(text: Column) -> Column:
    """Number of maximal runs of characters other than the six ASCII white-space characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the undirected graph with the edges (a, b): component is its smallest node.

    Alternates large-star and small-star steps, each staged.  Self loops and nulls are left out; an empty graph gives no row.
    """
    spark = edges.sparkSession
    pairs = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(),
        "edges",
    )
    state = _digest(pairs)
    if not state[0]:
        return spark.createDataFrame([], pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).schema)
    while True:
        nxt = staged(_small_star(_large_star(pairs)), "edges")
        now = _digest(nxt)
        drop_staged(pairs)
        pairs = nxt
        if now == state:
            break
        state = now
    tops = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _digest(pairs: DataFrame) -> tuple:
    r = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _lowest(both: DataFrame) -> DataFrame:
    """The smallest neighbour of each node.  Staged, so that the join with it is of two shuffled tables and can
    split the edges of a hub."""
    return staged(both.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("m", "u").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    low = _lowest(pairs)
    moved = pairs.join(low, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
