"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of a word budget by its weight.  A source whose share lies above
``max_epochs`` times its own size is clamped there, and the excess is shared again by weight among
the rest until none is above.  Each document of a source is then taken a whole number of times, and
a fractional repetition goes through the source in a seeded order until the target is met; the
document at the cut gives its first words only, so a source meets its target to the word.

Defined results: null text has size 0; a null source is a source of its own, last in order; sources
without words have target 0; equal (order key, doc_id, size) rows are interchangeable; an empty
table gives no row; all other columns of the input are kept by ``mix`` and unread by ``mix_amounts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, staged, words_ascii_space

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 17
_BITS = 12  # of the order key, in each of the two levels that locate the cut


def order_key(doc_id: Column, seed: int) -> Column:
    """60 seeded bits that order the documents of a source."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight): the weights repeat over the sources in code point order, null last."""
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = staged(
        per.repartitionByRange(parallelism(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    before, start = 0, {}
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        start[r["part"]] = before
        before += r["count"]
    first = F.lit(0)
    for part, n in start.items():
        first = F.when(F.col("part") == part, F.lit(n)).otherwise(first)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + first
    cycle = F.array(*[F.lit(w) for w in weights])
    return ranged.select("source", "source_size", F.element_at(cycle, (rank % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight).

    Each round is one aggregation that returns three numbers, whatever the number of sources.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg((F.sum("source_size") * F.lit(budget)).alias("t")).first()["t"]
    if total is None:
        return sources.withColumn("target", F.lit(None).cast("double"))
    level, clamped = 0.0, -1
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        r = sources.agg(
            F.sum(F.when(over, cap).otherwise(0)).alias("cap"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(over).alias("n"),
        ).first()
        if r["n"] == clamped or not r["weight"]:
            break
        clamped, level = r["n"], (float(total) - r["cap"]) / r["weight"]
    every = not r["weight"]
    return sources.withColumn("target", cap.cast("double") if every else F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def _cut(rows: DataFrame, bucket: str, left: str) -> DataFrame:
    """For each source the bucket in which its ``left`` words run out, and the words left there."""
    sums = rows.groupBy("source", left, bucket).agg(F.sum("size").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy(bucket))
    return (
        sums.withColumn("end", so_far)
        .where((F.col("end") > F.col(left)) & (F.col("end") - F.col("n") <= F.col(left)))
        .select("source", F.col(bucket).alias(f"cut_{bucket}"), (F.col(left) - F.col("end") + F.col("n")).alias(f"left_{bucket}"))
    )


def _joined(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    other = per_source.withColumnRenamed("source", "_source")
    return rows.join(other, rows["source"].eqNullSafe(other["_source"]), how).drop("_source")


def _levels(df: DataFrame) -> DataFrame:
    key = F.col("_key")
    return df.withColumns({"b1": F.shiftright(key, 60 - _BITS), "b2": F.shiftright(key, 60 - 2 * _BITS) % (1 << _BITS)})


def plan(sizes: DataFrame, weighted: DataFrame, seed: int, budget: float, max_epochs: int) -> tuple[DataFrame, DataFrame]:
    """Per source: target, whole repetitions and the cut of the fractional one; and the extra words of the
    few documents in the cut's bucket (one in 16 million of a source's rows, for any size)."""
    filled = water_fill(weighted, budget, max_epochs)
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    src = staged(
        filled.withColumn("whole", whole).withColumn("rest", (words - F.col("whole") * F.col("source_size")).cast("long")),
        "targets",
    )
    keyed = _levels(sizes.withColumn("_key", order_key(F.col("doc_id"), seed)))
    wanted = src.where("rest > 0").select("source", "rest")
    cut1 = staged(_cut(_joined(keyed.select("source", "size", "b1"), wanted), "b1", "rest"), "cut")
    in1 = _joined(keyed, cut1).where("b1 = cut_b1")
    cut2 = staged(_cut(in1, "b2", "left_b1"), "cut")
    cuts = _joined(src, _joined(cut1, cut2.withColumnRenamed("left_b2", "left"), "left"), "left")
    in2 = _joined(in1, cut2).where("b2 = cut_b2")
    before = F.sum("size").over(Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left_b2") - F.coalesce(before, F.lit(0))))
    nth = F.row_number().over(Window.partitionBy("source", "_key", "doc_id", "size").orderBy(F.lit(1)))
    at_cut = in2.withColumns({"extra": extra, "nth": nth}).select("source", "_key", "doc_id", "size", "extra", "nth")
    return staged(cuts.select("source", "source_size", "target", "whole", "rest", "cut_b1", "cut_b2"), "cuts"), staged(at_cut, "at-cut")


def _apply(rows: DataFrame, cuts: DataFrame, at_cut: DataFrame, seed: int) -> DataFrame:
    """rows (with doc_id, source, size) and source_size, target, whole, extra."""
    r = _levels(_joined(rows.withColumn("_key", order_key(F.col("doc_id"), seed)), cuts, "left"))
    b1, b2 = F.col("b1") - F.col("cut_b1"), F.col("b2") - F.col("cut_b2")
    here = F.coalesce((b1 == 0) & (b2 == 0), F.lit(False))
    free = F.when(F.col("cut_b1").isNull() | (b1 > 0), 0).when(b1 < 0, F.col("size")).when(b2 < 0, F.col("size")).otherwise(0)
    away = r.where(~here).withColumn("extra", free.cast("long"))
    names = ["source", "_key", "doc_id", "size"]
    near = r.where(here).withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(1))))
    c = at_cut.select(*[F.col(x).alias(f"c_{x}") for x in (*names, "nth")], F.col("extra").cast("long").alias("extra"))
    same = (F.col("_nth") == F.col("c_nth")) & F.col("source").eqNullSafe(F.col("c_source")) & F.col("doc_id").eqNullSafe(F.col("c_doc_id"))
    near = near.join(c, same & (F.col("_key") == F.col("c__key")) & (F.col("size") == F.col("c_size")), "left").drop("_nth", *c.columns[:-1])
    return away.unionByName(near).drop("_key", "b1", "b2", "cut_b1", "cut_b2", "rest")


def mix_amounts(docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    ``weights``: optional (source, weight); else WEIGHTS repeat over the sources in code point order.
    """
    sizes = staged(docs.select("doc_id", "source", words_ascii_space(F.col("text")).alias("size")), "sizes")
    cuts, at_cut = plan(sizes, _weighted(sizes, weights), seed, budget, max_epochs)
    got = _apply(sizes, cuts, at_cut, seed)
    taken = F.col("whole") * F.col("size") + F.col("extra")
    return got.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _weighted(sizes: DataFrame, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        return staged(cyclic_weights(sizes), "weighted")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return staged(_joined(per, weights.select("source", "weight")).select("source", "source_size", "weight"), "weighted")


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: each row of ``docs`` once for each whole repetition that it is taken for, and
    the one at a source's cut once more with its first words.  Columns as in ``docs``."""
    names = docs.columns
    sizes = staged(docs.select("doc_id", "source", words_ascii_space(F.col("text")).alias("size")), "sizes")
    cuts, at_cut = plan(sizes, _weighted(sizes, weights), seed, budget, max_epochs)
    inner = docs.select("doc_id", "source", words_ascii_space(F.col("text")).alias("size"), F.struct(*names).alias("_row"))
    got = _apply(inner, cuts, at_cut, seed).select("_row", "size", "whole", "extra")
    full = F.col("whole") + F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    part = F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), F.array(F.col("extra"))).otherwise(F.array().cast("array<bigint>"))
    copies = F.concat(F.transform(F.sequence(F.lit(1), F.greatest(full, F.lit(1)).cast("int")), lambda _: F.lit(None).cast("bigint")), part)
    copies = F.when(full > 0, copies).otherwise(part)
    out = got.select("_row", F.explode(copies).alias("_words"))
    lead = F.regexp_substr("_row.text", F.concat(F.lit(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("_words") - 1, F.lit(r"}+[^\x20\x09-\x0D]++")))
    text = F.when(F.col("_words").isNull(), F.col("_row.text")).otherwise(lead)
    cut = {"text": text} | ({"n_chars": F.when(F.col("_words").isNull(), F.col("_row.n_chars")).otherwise(F.length(lead).cast("long"))} if "n_chars" in names else {})
    return out.select(*[cut.get(x, F.col(f"_row.`{x}`")).alias(x) for x in names])
