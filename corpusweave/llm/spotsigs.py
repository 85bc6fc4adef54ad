"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A signature is an anchor with the next CHAIN content words; a text's fingerprint is its set of
signatures, written as sorted 40-bit hashes in hexadecimal.  Likeness is the pruned Jaccard coefficient of two
sets: sets are partitioned by length, only those of one or neighbouring partitions are compared, a
comparison that can't reach the least likeness is broken off, and what lies under that is given as 0.

Defined results: null and empty texts have the empty fingerprint; a text without any complete signature
has one signature, of all its words (of the whole text where it has no word); two empty fingerprints
have likeness 1, an empty and another one 0.  Equal texts have equal fingerprints.  Rows with equal ids
are ordered by text; null ids come first.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_splits, parallelism, range_of, staged

# Anchors, and further common words that are no content, in four languages.
ANCHORS = frozenset("the of and a to in is was that for der die und ist von in le la de et est les el que los en un y".split())
COMMON = ANCHORS | frozenset(
    "an and are as at be by for from had has have he her his in it its not of on or she this to were with you "
    "das den dem des ein eine einer für im in mit nicht sich zu auf auch als "
    "les des du une dans pour par sur pas qui il elle au aux ce avec "
    "las del y o una por con para se su al lo como más no".split()
)
CHAIN = 2
WIDTH = 10  # hexadecimal digits of a signature
_STEP = 64  # signatures that are compared at once
_WORD = re.compile(r"[^\W_]+")


def signatures(text: str | None) -> list[str]:
    """The sorted distinct signatures of a text."""
    if not text:
        return []
    words = _WORD.findall(text.lower())
    found, one, two = set(), "", ""
    for w in reversed(words):
        if w in COMMON:
            if two and w in ANCHORS:
                found.add(f"{w} {one} {two}")
        else:
            one, two = w, one
    if not found:
        found.add(" ".join(words) or text)
    return sorted({xxhash.xxh64_hexdigest(s.encode("utf-8", "surrogatepass"))[:WIDTH] for s in found})


def fingerprint(text: str | None) -> str:
    return "".join(signatures(text))


def split(mark: str) -> list[str]:
    return [mark[i : i + WIDTH] for i in range(0, len(mark), WIDTH)]


def length_partition(n: int, least: float) -> int:
    """Number of the partition of sets of length ``n``, so wide that sets of likeness ``least`` lie in one or neighbours."""
    return int(math.log(n) / -math.log(least) + 1e-9) if n else -1


def jaccard(a: list[str], b: list[str], least: float = 0.0) -> float:
    """Jaccard coefficient of two sets of distinct signatures; 0 where it lies under ``least``, exact without one.

    Sets more than a length partition apart are not compared, and a comparison ends as soon as what is left of the
    shorter set can't reach ``least`` any more."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if least and length_partition(len(long), least) - length_partition(len(short), least) > 1:
        return 0.0
    other, both, need = set(long), 0, least * (len(a) + len(b)) / (1 + least) - 1e-9
    for i in range(0, len(short), _STEP):
        if both + len(short) - i < need:
            return 0.0
        both += len(other.intersection(short[i : i + _STEP]))
    return both / (len(a) + len(b) - both) if both >= need else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_signatures) of every row of ``docs`` (doc_id, text)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.string()), pa.array([len(m) // WIDTH for m in marks], pa.int64())], ["doc_id", "fingerprint", "n_signatures"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {kind}, fingerprint string, n_signatures long")


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(mark_a, mark_b, likeness): pairs of different fingerprints with likeness of ``least`` or more.

    Equal fingerprints are one row from the start.  Signatures are ordered from the rarest; two sets can
    only be alike enough if they share one of the first ``n - ceil(least * n) + 1``, so only those
    are joined, within the same or the next length partition.
    """
    marks = staged(fingerprints(docs).where("n_signatures > 0").select("fingerprint", "n_signatures").distinct(), "marks")
    sig = F.explode(F.expr(f"transform(sequence(0, cast(n_signatures as int) - 1), i -> substring(fingerprint, i * {WIDTH} + 1, {WIDTH}))"))
    rows = marks.select("fingerprint", "n_signatures", sig.alias("sig"))
    rare = rows.groupBy("sig").count()
    need = F.col("n_signatures") - F.ceil(F.col("n_signatures") * F.lit(least) - 1e-9) + 1
    ordered = rows.join(rare, "sig").groupBy("fingerprint", "n_signatures").agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("s"))
    prefix = ordered.select("fingerprint", "n_signatures", F.explode(F.slice("s", F.lit(1), need.cast("int"))).alias("p")).select(
        "fingerprint", "n_signatures", F.col("p.sig").alias("sig"), F.floor(F.log(F.col("n_signatures").cast("double")) / F.lit(-math.log(least)) + 1e-9).alias("size_class")
    )
    a = prefix.select(F.col("fingerprint").alias("mark_a"), F.col("n_signatures").alias("n_a"), "sig", F.explode(F.array(*[F.col("size_class") + k for k in (0, 1)])).alias("size_class"))
    b = prefix.select(F.col("fingerprint").alias("mark_b"), F.col("n_signatures").alias("n_b"), "sig", "size_class")
    fits = (F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b")) & (F.col("mark_a") != F.col("mark_b"))
    pairs = a.join(b, ["sig", "size_class"]).where(fits).select(F.least("mark_a", "mark_b").alias("mark_a"), F.greatest("mark_a", "mark_b").alias("mark_b")).distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            likes = [jaccard(split(p), split(q), least) for p, q in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(likes, pa.float64())], ["mark_a", "mark_b", "likeness"])

    return pairs.mapInArrow(check, "mark_a string, mark_b string, likeness double").where("likeness > 0")


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id and OUT for every row of ``docs`` (doc_id, text): how far the fingerprint follows an edit that
    puts the start of the next document (by id; after the last the first) in place of the last quarter.

    The texts are shuffled once, by ranges of the id; the row that starts a range also goes to the range
    before it, where it is the next document of the last one.
    """
    parts = parallelism(docs.sparkSession)
    base = docs.select("doc_id", "text")
    splits = key_splits(base, "doc_id", parts)
    lowest = base.agg(F.min("doc_id").alias("lo"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    nth = range_of(F.col("doc_id"), splits)
    first = F.col("doc_id").isNull() if lowest["nulls"] else F.col("doc_id") == F.lit(lowest["lo"])
    starts = F.when(first, F.array(F.lit(len(splits)))).when(F.col("doc_id").isin(splits) if splits else F.lit(False), F.array(nth - 1)).otherwise(F.array().cast("array<int>"))
    spread = (
        base.withColumn("_own", nth)
        .withColumn("_to", F.concat(F.array(F.struct(F.col("_own").alias("part"), F.lit(False).alias("peek"))), F.transform(starts, lambda p: F.struct(p.cast("int").alias("part"), F.lit(True).alias("peek")))))
        .select("doc_id", "text", F.explode("_to").alias("_to"))
        .select("_to.part", "_to.peek", "doc_id", "text")
    )
    ordered = spread.repartitionById(len(splits) + 1, "part").sortWithinPartitions("part", "peek", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out: list[tuple] = []
        last = None  # range, id, text and signatures of the row before, which waits for its next
        for k, peek, doc_id, text in rows():
            if last and last[0] == k:
                out.append(edit(*last[1:], text := text or "", sigs := signatures(text)))
            else:
                sigs = None
            # of the rows that only show what comes next, the first is enough
            last = None if peek else (k, doc_id, text or "", signatures(text) if sigs is None else sigs)
            if len(out) >= 256:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def edit(doc_id, text: str, own: list[str], after: str, next_sigs: list[str]) -> tuple:
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        other = own if new == text else signatures(new)
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, "".join(own), "".join(other), jaccard(own, other), jaccard(own, next_sigs)

    kinds = [docs.schema["doc_id"].dataType.simpleString()]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    names = ["doc_id", *[x.split()[0] for x in OUT.split(", ")]]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return ordered.select("part", "peek", "doc_id", "text").mapInArrow(part, f"doc_id {kinds[0]}, {OUT}")
