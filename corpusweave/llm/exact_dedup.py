"""Exact duplicates: groups by a 128-bit content hash, the smallest stable id stays, bytes are compared in each group.

Texts are equal when they are identical after deleting the six ASCII white-space characters; null counts as empty.  Of equal
texts the longest original stays, then the smallest id (a null id comes last), then the row that the table gives
first.  Empty and null texts are equal to each other.  Repeated rows are copies like any other: one stays.

The first pass keeps a narrow row for each document.  Only texts whose hash may occur twice are looked at again:
each task compares the copies that it holds and sends one smallest and one largest text for a hash, so a group of a
third of all rows costs a shuffle two texts a task.  Where a hash does hold different texts, each gets a number of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged, unused

#: Bits of a hash that name the bucket a row is looked up in before texts move: at most 2**20 small numbers are broadcast.
BUCKET_BITS = 20


def without_space(text: Column) -> Column:
    """The text without its white space; null becomes the empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def md5_128(content: Column) -> Column:
    return F.unhex(F.md5(content))


def _bucket(digest: Column) -> Column:
    return F.conv(F.substring(F.hex(digest), 1, BUCKET_BITS // 4), 16, 10).cast("int")


def _in_buckets(df: DataFrame, digests: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` whose bucket holds (``left_semi``) or doesn't hold (``left_anti``) one of the digests.

    The broadcast side has at most 2**BUCKET_BITS rows of one integer."""
    buckets = digests.select(_bucket(F.col("digest")).alias("bucket")).distinct()
    return df.withColumn("bucket", _bucket(F.col("digest"))).join(F.broadcast(buckets), "bucket", how).drop("bucket")


def _hashed(df: DataFrame, key: str, text: str, content: Callable[[Column], Column], digest: Callable[[Column], Column]) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), content(F.col(text)).alias("body")).withColumn("digest", digest(F.col("body")))


def _narrow(rows: DataFrame) -> DataFrame:
    return rows.select("id", "n_chars", "digest", "sub", F.sha2("body", 256).alias("sha"), F.monotonically_increasing_id().alias("row"))


def _groups(rows: DataFrame) -> DataFrame:
    """(digest, sub, n, best) of what occurs more than once."""
    best = F.min(F.struct((-F.col("n_chars")).alias("shortness"), F.col("id").isNull().alias("no_id"), "id", "row"))
    return rows.groupBy("digest", "sub").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1")


def _numbered(hashed: DataFrame, clash: DataFrame) -> DataFrame:
    """Rows with ``sub``: the number of a text among the different ones of its hash, 0 where the hash holds one."""
    apart = _in_buckets(hashed, clash, "left_anti").withColumn("sub", F.lit(0))
    near = _in_buckets(hashed, clash, "left_semi")
    bodies = near.join(clash, "digest", "left_semi").select("digest", "body").distinct()
    subs = bodies.select("digest", "body", F.row_number().over(Window.partitionBy("digest").orderBy("body")).alias("sub"))
    return apart.unionByName(near.join(subs, ["digest", "body"], "left").withColumn("sub", F.coalesce("sub", F.lit(0))).select(*apart.columns))


def copies(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    content: Callable[[Column], Column] = without_space,
    digest: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256, n_chars), one row for each row of ``df``.

    ``content`` says what of a text is compared, ``digest`` hashes it; a weak hash costs time, never a result.
    An empty table gives no row; other columns of ``df`` are not read.
    """
    hashed = _hashed(df, key, text, content, digest)
    rows = staged(_narrow(hashed.withColumn("sub", F.lit(0))), "copies")
    groups = staged(_groups(rows), "copy-groups")
    extremes = _in_buckets(hashed, groups, "left_semi").groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    clash = staged(extremes.where("low <> high").select("digest"), "copy-clash")
    if not clash.isEmpty():
        drop_staged(rows, groups)
        rows = staged(_narrow(_numbered(hashed, clash)), "copies")
        groups = staged(_groups(rows), "copy-groups")
    drop_staged(clash)
    joined = rows.join(groups, ["digest", "sub"], "left")
    alone = F.col("n").isNull()
    return joined.select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n_chars",
    )


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, its columns as they are.

    Only the winners of ``copies`` are joined back; rows that repeat a winner's id and text give one row.
    """
    sha, chars, nth = unused(df, "sha", "chars", "nth")
    won = copies(df, key, text).where("kept").select(F.col("text_sha256").alias(sha), F.col("n_chars").alias(chars), F.col(key).alias("won_id"))
    found = df.withColumns({sha: F.sha2(without_space(F.col(text)), 256), chars: F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")})
    kept = found.alias("f").join(won.alias("w"), (F.col(f"f.{sha}") == F.col(f"w.{sha}")) & (F.col(f"f.{chars}") == F.col(f"w.{chars}")) & F.col(f"f.{key}").eqNullSafe(F.col("w.won_id"))).select("f.*")
    ranked = kept.withColumn(nth, F.row_number().over(Window.partitionBy(sha).orderBy(F.monotonically_increasing_id())))
    return ranked.where(F.col(nth) == 1).select(*df.columns)
