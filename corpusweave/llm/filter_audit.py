"""How filters interact: a CUBE over failure flags and part gives the survivors of every subset of the filters.

A document fails A with under 200 words, B where under half of its words are distinct, C where over 2% of its
characters are A-Z, D where it holds one of ``#$%&*|``, E where a smaller id has the identical text (identical by SHA-256).
A grouping-set row in which all selected flags are false counts what survives those filters; an order of filters
is a walk through subsets, so each of its steps is one pair of them.

Null text is the empty text, null source the part ''.  A row without id is never a copy of another and copies no
other; rows that repeat an id are counted each, and are no copies of each other.  Several labels of one id count as one, by the highest value.
An empty table gives no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

FILTERS = "ABCDE"
_SPACE = " \t\n\x0b\f\r"


def failures(docs: DataFrame) -> DataFrame:
    """(id, part, sha, A, B, C, D): one narrow row for each document, with the flags that its text alone decides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    body = F.btrim(text, F.lit(_SPACE))
    words = F.split(body, r"[\x20\x09-\x0D]+")
    none = (body == "").cast("int")
    narrow = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("source"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("sha"),
        (F.size(words) - none).cast("long").alias("words"),
        (F.size(F.array_distinct(words)) - none).cast("long").alias("kinds"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("capitals"),
        F.length(text).cast("long").alias("chars"),
        text.rlike(r"[#$%&*|]").alias("D"),
    )
    return narrow.select("id", "part", "sha", (F.col("words") < 200).alias("A"), (100 * F.col("kinds") < 50 * F.col("words")).alias("B"), (100 * F.col("capitals") > 2 * F.col("chars")).alias("C"), "D")


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds E.  The smallest id of each text is found with counts taken before the shuffle, and looked up by text
    and id together, so a text that very many rows share is spread like any other: a row that isn't found is a copy."""
    first = rows.groupBy("sha").agg(F.min("id").alias("id")).where("id is not null").withColumn("own", F.lit(True))
    return rows.join(first, ["sha", "id"], "left").withColumn("E", F.col("own").isNull() & F.col("id").isNotNull()).drop("own", "sha")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``; a document without a label has neither."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(known, "id", "left").fillna(0, ["good", "toxic"])


def survivors(flags: DataFrame, of_parts: bool = True) -> DataFrame:
    """(part, mask, kept, good, toxic): what no filter of the subset ``mask`` removes, zeros included.

    Bit i of ``mask`` is the filter FILTERS[i].  ``of_parts=False`` gives the whole table's rows, whose part is null.
    The documents are counted by flags and part first, so the CUBE expands at most 32 rows a part.
    """
    counted = staged(flags.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "audit")
    cube = counted.cube(*FILTERS, "part").agg(F.grouping_id().alias("left_out"), F.sum("n").alias("kept"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    left_out = F.col("left_out")  # a bit for each grouping column, the first the highest; set where the column isn't selected
    chosen = [left_out.bitwiseAND(1 << (len(FILTERS) - i)) == 0 for i in range(len(FILTERS))]
    clean = F.lit(True)
    for letter, on in zip(FILTERS, chosen, strict=True):
        clean = clean & (~on | ~F.col(letter))
    mask = sum((F.when(on, 1 << i).otherwise(0) for i, on in enumerate(chosen)), F.lit(0))
    parted = left_out.bitwiseAND(1) == (0 if of_parts else 1)
    alive = cube.where(clean & parted).select("part", mask.alias("mask"), "kept", "good", "toxic")
    parts = counted.select("part").distinct() if of_parts else counted.select(F.lit(None).cast("string").alias("part")).distinct()
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("mask"))
    same = F.col("g.part").eqNullSafe(F.col("s.part")) & (F.col("g.mask") == F.col("s.mask"))
    got = grid.alias("g").join(alive.alias("s"), same, "left").select("g.part", "g.mask", "kept", "good", "toxic")
    return got.fillna(0, ["kept", "good", "toxic"])


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def steps(spark) -> DataFrame:
    """(filter_order, step, letter, mask, after): the 600 steps of all orders; ``mask`` is what came before."""
    rows = []
    for order in permutations(FILTERS):
        mask = 0
        for i, letter in enumerate(order, 1):
            rows.append(("".join(order), i, letter, mask, mask | _bit(letter)))
            mask |= _bit(letter)
    return spark.createDataFrame(rows, "filter_order string, step int, letter string, mask int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step; counts of documents within the part.

    ``kept`` after the step, ``removed`` by it, ``redundant``: failing its filter but removed earlier, ``unique_fails``: failing
    its filter alone, ``good_lost`` and ``toxic_lost``: removed labelled documents, ``shapley``: what its filter removes, summed over all orders.
    """
    alive = staged(survivors(with_labels(with_copies(failures(docs)), labels)), "survivors")
    full = (1 << len(FILTERS)) - 1
    count = lambda mask: F.max(F.when(F.col("mask") == mask, F.col("kept")))
    letters = [F.struct(F.lit(x).alias("letter"), (count(0) - count(_bit(x))).alias("fails"), (count(full - _bit(x)) - count(full)).alias("unique_fails")) for x in FILTERS]
    fails = alive.groupBy("part").agg(F.array(*letters).alias("xs")).select("part", F.inline("xs"))
    after = alive.select(F.col("part"), F.col("mask").alias("after"), *[F.col(c).alias(f"{c}_after") for c in ("kept", "good", "toxic")])
    walk = F.broadcast(steps(docs.sparkSession))  # 600 rows, whatever the input
    pairs = alive.join(walk, "mask").join(after, ["part", "after"]).join(fails, ["part", "letter"])
    removed: Column = F.col("kept") - F.col("kept_after")
    rows = pairs.select(
        "part", "filter_order", "step", "letter", F.col("kept_after").alias("kept"), removed.alias("removed"), (F.col("fails") - removed).alias("redundant"),
        "unique_fails", (F.col("good") - F.col("good_after")).alias("good_lost"), (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"),
    )
    shapley = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "letter"]).drop("letter")
