"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item (an item of fewer words is one window).  Its words are
ordered by rarity over all documents.  A document holds a window only if it holds every word of it, so of a set
of n words, n - n + 1 = 1 have to be joined: the prefix is the single rarest word, the anchor.  Where that
stands in a document, the window can only lie at one place: bounds on position and length come first, then
the words are compared.

The texts are split once for the join.  Anchors are broadcast in blocks of at most BLOCK words, so what is
broadcast has a bound; a benchmark of more anchors takes more passes over the texts, and nothing else changes.
No word of a document is shuffled but those at anchors, and no anchor, however common, meets in one task.

Words: A-Z lower-cased, runs of ASCII letters and digits and of all characters above ASCII.  DataFrame
functions only.

Defined results: null and empty texts have no word and are not contaminated; items without a word are no
windows; an empty benchmark marks nothing; equal rows get equal results (a row is known by its id and its
text); equal items with different ids each count; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused

WINDOW = 13
SHARE = 20  # a document is contaminated where SHARE times its hit words reach its words
BLOCK = 100_000  # words that are broadcast at a time
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """The words of a text, exactly."""
    return _split(F.translate(text, _UPPER, _LOWER))


def _split(text: Column) -> Column:
    """The words of a text at their places, as they are written; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_GAPS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP))


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, window): every window of every item, its words in order."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at")
    return items.select("item_id", "w", length.alias("length"), starts).select("item_id", "length", F.slice("w", F.col("at"), F.col("length")).alias("window"))


def _blocks(table: DataFrame, column: str, size: int) -> list[DataFrame]:
    """The distinct values of ``column`` in tables of about ``size`` rows."""
    distinct = table.select(column).distinct()
    n = -(-distinct.count() // size)
    if n < 2:
        return [distinct]
    return [distinct.where(F.pmod(F.xxhash64(column), F.lit(n)) == i) for i in range(n)]


def word_counts(docs: DataFrame, vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, count) over all documents of the words in ``vocabulary`` (word), each lowered on its own.

    lower makes words equal that translate makes equal, and is faster.  It is taken of one word, never of more, as
    the small form of a Greek sigma hangs on what follows."""
    each = docs.select(F.explode(F.split(F.col("text"), _GAP)).alias("word")).select(F.lower("word").alias("word"))
    parts = [each.join(F.broadcast(b), "word").groupBy("word").count() for b in _blocks(vocabulary, "word", block)]
    return staged(_union(parts), "counts")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def anchors(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, length, window, anchor, before, word): each window with its rarest word, the number of words
    before that, and the word as ``lower`` writes it.

    Counts are joined to the distinct words of an item, so a common word is no more than a row for each item."""
    known = F.map_from_entries(F.collect_list(F.struct("word", F.coalesce("count", F.lit(0).cast("long")).alias("count"))))
    each = wins.select("item_id", F.explode("window").alias("w")).select("item_id", F.lower("w").alias("word")).distinct()
    per = each.join(counts, "word", "left").groupBy("item_id").agg(known.alias("counts")).withColumnRenamed("item_id", "_item")
    ranked = F.array_min(F.transform("window", lambda w, i: F.struct(F.element_at("counts", F.lower(w)).alias("count"), F.lower(w).alias("word"), i.alias("before"))))
    both = wins.distinct().join(per, F.col("item_id").eqNullSafe(F.col("_item"))).select("item_id", "length", "window", ranked.alias("r"))
    return both.select("item_id", "length", "window", F.element_at("window", F.col("r.before") + 1).alias("anchor"), F.col("r.before").alias("before"), F.col("r.word").alias("word"))


def _places(docs: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """(doc_id, key, n_words, at, lead, around, word): places of anchor words in docs (doc_id, key, text), each with
    up to 12 words on either side, ``lead`` of them before it."""
    each = docs.select("doc_id", "key", _split(F.col("text")).alias("w"))
    each = each.select("doc_id", "key", "w", F.posexplode("w").alias("at", "raw")).withColumn("word", F.lower("raw"))
    lead = F.least(F.col("at"), F.lit(WINDOW - 1))
    near = F.slice("w", F.col("at") - lead + 1, lead + WINDOW)
    around = F.transform(near, lambda w: F.translate(w, _UPPER, _LOWER))
    parts = [each.join(F.broadcast(b), "word").select("doc_id", "key", F.size("w").alias("n_words"), "at", lead.alias("lead"), around.alias("around"), "word") for b in _blocks(found, "word", block)]
    return staged(_union(parts), "places")


def contamination(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, key, n_words, n_hit, item_ids, contaminated) of every row of ``docs`` (doc_id, text)."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    wins = staged(windows(benchmark), "windows")
    vocabulary = wins.select(F.explode("window").alias("word")).select(F.lower("word").alias("word"))
    found = staged(anchors(wins, word_counts(keyed, vocabulary, block)), "anchors")
    at = _places(keyed, found, block)
    start = F.col("at") - F.col("before")
    fits = (F.col("before") <= F.col("lead")) & (start + F.col("length") <= F.col("n_words"))
    same = F.slice("around", F.col("lead") - F.col("before") + 1, F.col("length")) == F.col("window")
    # both sides are staged, so that the join can split the places of a common word
    hits = at.join(found, "word").where(fits).where(same).select("doc_id", "key", "item_id", F.struct(start.alias("s"), (start + F.col("length")).alias("e")).alias("span"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")),
        lambda a: a["n"],
    )
    per = hits.groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("item_ids"))
    per = staged(per.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), covered.alias("n_hit"), "item_ids"), "hits")
    sized = keyed.select("doc_id", "key", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = sized.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.array().cast(per.schema["item_ids"].dataType)
    return out.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    id_, key_ = unused(docs, "_id", "_key")
    bad = contamination(docs, benchmark, block).where("contaminated").select(F.col("doc_id").alias(id_), F.col("key").alias(key_)).distinct()
    return docs.join(staged(bad, "contaminated"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key_)), "left_anti")
