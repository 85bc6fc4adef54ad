"""Joins on intervals, edit distance, dictionaries and grams, each brought to an equi-join.

Every function takes DataFrames of any size and gives each matching pair once.  None plans a nested loop: intervals meet in
time cells, strings in shared segments, terms in token n-grams.  The join key is a value of the data, so a hot one is
split by Spark's skew join, as both sides come from a shuffle; what is verified after it stays inside the join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.sources.files import staged

# ---------------------------------------------------------------- intervals


def interval_join(points: DataFrame, windows: DataFrame, at: str, low: str, high: str, keys: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``points`` and ``windows`` with low <= at <= high and equal ``keys``, each pair once; integer times.

    A window lies in cells as wide as itself, rounded up to a power of four, so it touches two of them at most;
    a point is looked up once for each width that occurs, at most 32.  ``optional`` keys match every point where the window's is null.
    Windows that end before they begin, and nulls in times or keys, match nothing.  Joins are merges: cells multiply rows
    unseen by Spark's size estimates, so a broadcast could fill the driver.
    """
    valid = windows.where(F.col(low) <= F.col(high))
    wide = F.ceil(F.log2(F.col(high) - F.col(low) + 1) / 2).cast("int")  # cells of 4 ** wide
    sized = valid.withColumn("_wide", wide)
    widths = sorted(r[0] for r in sized.select("_wide").distinct().collect())
    if not widths:
        widths = [0]
    cell = lambda t, w: F.floor(t / F.pow(F.lit(4.0), w)).cast("long")
    placed = sized.withColumn("_cell", F.explode(F.sequence(cell(F.col(low), F.col("_wide")), cell(F.col(high), F.col("_wide")))))
    looked = points.withColumn("_w", F.explode(F.array(*[F.lit(w) for w in widths]))).withColumn("_c", cell(F.col(at), F.col("_w")))
    out = None
    for chosen in _subsets(optional):
        some = placed
        for k in optional:
            some = some.where(F.col(k).isNotNull() if k in chosen else F.col(k).isNull())
        on = (F.col("p._w") == F.col("w._wide")) & (F.col("p._c") == F.col("w._cell")) & F.col(f"p.{at}").between(F.col(f"w.{low}"), F.col(f"w.{high}"))
        for k in (*keys, *chosen):
            on = on & (F.col(f"p.{k}") == F.col(f"w.{k}"))
        shared = {*keys, *optional}
        got = looked.alias("p").join(some.hint("merge").alias("w"), on).select(*[f"p.{c}" for c in points.columns], *[f"w.{c}" for c in windows.columns if c not in shared])
        out = got if out is None else out.unionByName(got)
    return out


def interval_usage(points: DataFrame, windows: DataFrame, of: str, at: str, low: str, high: str, value: str, keys: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> DataFrame:
    """(of, calls, total): for each window that ``interval_join`` gives a row, the number of its points and the sum of their ``value``.

    No pair is formed, so the work grows with points and windows and not with their product.  Cells are at most as wide as the
    window, down to a quarter; so it takes the rear of its first cell, the front of its last and up to three whole ones between, which are
    running counts and sums within cells.  Nothing is subtracted, so values outside a window leave no trace in its sum.
    """
    valid = windows.where(F.col(low) <= F.col(high)).withColumn("_w", F.expr(f"(length(bin({high} - {low} + 1)) - 1) div 2").cast("int"))
    widths = sorted(r[0] for r in valid.select("_w").distinct().collect()) or [0]  # at most 32
    cell = lambda t: F.expr(f"({t} - pmod({t}, shiftleft(1L, 2 * _w))) div shiftleft(1L, 2 * _w)")
    out = None
    for chosen in _subsets(optional):
        by = [*keys, *chosen]
        some = valid.where(F.col(of).isNotNull())
        for k in (*keys, *optional):
            some = some.where(F.col(k).isNull() if k in optional and k not in chosen else F.col(k).isNotNull())
        met = points.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
        met = met.withColumn("_w", F.explode(F.array(*[F.lit(w) for w in widths]))).select(*by, "_w", cell(at).alias("_cell"), F.col(at).cast("long").alias("_t"), "_n", "_v")
        placed = some.withColumns({"_a": cell(low), "_b": cell(high)})
        ends = F.expr(f"""concat(array(struct(_a AS _cell, CAST({low} AS BIGINT) AS _t, false AS _up)),
            if(_b > _a, array(struct(_b AS _cell, CAST({high} AS BIGINT) AS _t, true AS _up)), array()),
            if(_b > _a + 1, transform(sequence(_a + 1, greatest(_b - 1, _a + 1)), c -> struct(c AS _cell, (c + 1) * shiftleft(1L, 2 * _w) - 1 AS _t, true AS _up)), array()))""")
        asked = placed.select(*by, "_w", of, F.inline(ends))
        both = met.unionByName(asked, allowMissingColumns=True)
        group = Window.partitionBy(*by, "_w", "_cell")
        front, rear = (group.orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow) for t in (F.col("_t"), F.col("_t").desc()))
        both = both.withColumns({f"{c}{e}": F.sum(c).over(w) for e, w in (("f", front), ("r", rear)) for c in ("_n", "_v")})
        got = both.where(F.col("_up").isNotNull()).select(of, *[F.when(F.col("_up"), F.col(f"{c}f")).otherwise(F.col(f"{c}r")).alias(c) for c in ("_n", "_v")])
        out = got if out is None else out.unionByName(got)
    return out.groupBy(of).agg(F.sum("_n").alias("calls"), F.sum("_v").alias("total")).where("calls > 0")


def _subsets(names: tuple[str, ...]) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for n in names:
        out += [(*s, n) for s in out]
    return out


def past_midnight(low: Column, high: Column, day: int = 86_400) -> Column:
    """The end of a window of clock times: a day later where it lies before the start."""
    return F.when(high < low, high + day).otherwise(high)


# ------------------------------------------------------------ edit distance


def near_strings(left: DataFrame, right: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """(a, b, d): pairs of strings at edit distance ``most`` or less, each pair of different rows' values once.

    A string is cut into most + 1 segments; of two strings that near, one segment of one occurs in the other, shifted
    by ``most`` places at most.  So both meet in an equi-join of (length, segment number, segment), and only those pairs are verified.
    Strings shorter than most + 1 have empty segments and meet all that are as short.
    """
    parts = most + 1

    def bounds(length: Column, i: int) -> tuple[Column, Column]:
        """Start and size of segment i of a string of that length; the last ones take what is over."""
        small, extra = F.floor(length / parts), length % parts
        first_long = parts - extra
        start = F.when(F.lit(i) <= first_long, small * i).otherwise(small * i + (F.lit(i) - first_long))
        return start.cast("int"), (small + F.when(F.lit(i) >= first_long, 1).otherwise(0)).cast("int")

    def segments(text: Column) -> Column:
        rows = []
        for i in range(parts):
            start, size = bounds(F.length(text), i)
            rows.append(F.struct(F.length(text).alias("length"), F.lit(i).alias("i"), F.substring(text, start + 1, size).alias("segment")))
        return F.array(*rows)

    def lookups(text: Column) -> Column:
        rows = []
        for change in range(-most, most + 1):
            length = F.length(text) + change
            for i in range(parts):
                start, size = bounds(length, i)
                for shift in range(-most, most + 1):
                    at = start + shift
                    fits = (length >= 0) & (at >= 0) & (at + size <= F.length(text))
                    rows.append(F.when(fits, F.struct(length.alias("length"), F.lit(i).alias("i"), F.substring(text, at + 1, size).alias("segment"))))
        return F.array_distinct(F.filter(F.array(*rows), lambda r: r.isNotNull()))

    index = left.where(F.col(a).isNotNull()).select(F.col(a).alias("a")).distinct().select("a", F.inline(segments(F.col("a"))))
    probe = right.where(F.col(b).isNotNull()).select(F.col(b).alias("b")).distinct().select("b", F.inline(lookups(F.col("b"))))
    key = ["length", "i", "segment"]
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key]
    met = index.alias("x").join(probe.alias("y"), [*on, F.levenshtein("a", "b", most) >= 0])
    return met.select("a", "b").distinct().withColumn("d", F.levenshtein("a", "b").cast("int"))


# --------------------------------------------------------------- dictionary

#: What parts the words of a term, and the pieces of folded text; a piece takes its seam along.
SEAM = r"[~\s]+"
_PIECE = r"([~\s]*(?:[a-z0-9_]+|[^a-z0-9_~\s]))"
_FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: Column) -> Column:
    """Words and single other characters of the ASCII-folded text; one that follows a seam begins with one space."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), *_FOLD), F.lit(_PIECE), F.lit(1))
    return F.transform(found, lambda p: F.regexp_replace(p, "^" + SEAM, " "))


def _term_pieces(term: Column) -> Column:
    return pieces(F.regexp_replace(F.coalesce(term, F.lit("")), f"^{SEAM}|{SEAM}$", ""))


BITS = 1 << 22  # of the bitmap of the dictionary that tasks look grams up in: 512 KB, however many terms there are
SMALL = 100_000  # terms that are sent to all tasks


def _bitmap(keys: DataFrame) -> bytes:
    """Bits crc32(key) mod BITS of the strings ``key``, as one block of bytes; made in tasks, at most 128 parts reach the driver."""
    bit = (F.crc32("key") % BITS + 1).alias("bit")  # buckets are counted from 1
    parts = keys.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("nr")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = bytearray(BITS // 8)
    for nr, bits in parts:
        out[(nr - 1) * 4096 : nr * 4096] = bits
    return bytes(out)


def term_candidates(docs: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, pos, n, gram): the grams of pieces of ``docs`` (key, text) that may be terms of ``known`` (n, gram, head), whole words only.

    A gram comes out where the bitmaps have its first piece, that with its length, and the gram; so all terms are among them, and few others.
    """
    heads, openings, grams = (_bitmap(known.select(c.alias("key"))) for c in (F.col("head"), F.concat_ws(":", "head", "n"), F.col("gram")))
    piece, seams = re.compile(_PIECE, re.ASCII), "~ \t\n\r\f\v"
    word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def has(bits: bytes, s: str) -> bool:
            bit = zlib.crc32(s.encode()) % BITS
            return bool(bits[bit >> 3] >> (bit & 7) & 1)

        class Begun(dict):
            """The lengths of the terms that may begin with a piece."""

            def __missing__(self, p: str) -> tuple[int, ...]:
                head = p.lstrip(seams)
                self[p] = got = tuple(n for n in lengths if has(openings, f"{head}:{n}")) if has(heads, head) else ()
                return got

        begun = Begun()
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                b = whole.slice(low, 256)
                at, out = [], []
                for r in range(b.num_rows):
                    ps = piece.findall((b.column(1)[r].as_py() or "").encode().lower().decode())  # bytes fold ASCII only
                    if len(begun) > 1 << 18:
                        begun.clear()
                    for i in [i for i, p in enumerate(ps) if begun[p]]:
                        if i and ps[i][0] not in seams and ps[i - 1][-1] in word:
                            continue
                        for n in begun[ps[i]]:
                            if i + n > len(ps) or (i + n < len(ps) and ps[i + n][0] in word):
                                continue
                            gram = ps[i].lstrip(seams) + "".join(p if p[0] not in seams else " " + p.lstrip(seams) for p in ps[i + 1 : i + n])
                            if has(grams, gram):
                                at.append(r)
                                out.append((i, n, gram))
                pos, n, gram = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(gram, pa.string())], ["key", "pos", "n", "gram"])

    return docs.mapInArrow(part, f"key {docs.schema['key'].dataType.simpleString()}, pos int, n int, gram string")


def term_places(docs: DataFrame, terms: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """(key, pos, n, term): where terms stand in texts, as whole words in any case, with white space or ties between their words.

    ``pos`` counts pieces from 0, ``n`` is their number.  Each text is read once; of its n-grams of pieces, for the lengths that the
    dictionary has, those that a bitmap of the dictionary lets through meet the terms in an equi-join; a term of any kind of characters
    is found.  Texts and terms that are null or blank give nothing, a term that is given twice counts once.
    """
    known = terms.select(F.col(term).alias("term")).distinct().withColumn("_p", _term_pieces(F.col("term"))).where(F.size("_p") > 0)
    known = staged(known.select("term", F.size("_p").alias("n"), F.array_join("_p", "").alias("gram"), F.element_at("_p", 1).alias("head")))
    sizes = dict(known.groupBy("n").count().collect())  # as many numbers as the longest term has pieces
    each = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    grams = term_candidates(each, known, sorted(sizes))
    small = sum(sizes.values()) <= SMALL
    return grams.join(known.select("term", "n", "gram").hint("broadcast" if small else "merge"), ["n", "gram"]).select(F.col("key").alias(key), "pos", "n", "term")


def longest_places(places: DataFrame, key: str) -> DataFrame:
    """The places without those that lie inside a longer one; of terms with the same pieces the first in order stays.

    A place lies inside another if that begins no later and ends no earlier: running maxima of one text's places tell.
    """
    best = places.groupBy(key, "pos", "n").agg(F.min("term").alias("term"))
    earlier = Window.partitionBy(key).orderBy("pos", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("n")
    return best.withColumn("_reach", F.max(end).over(earlier)).where(F.col("_reach").isNull() | (end > F.col("_reach"))).drop("_reach")


# -------------------------------------------------------------------- grams


def gram_anchors(docs: DataFrame, items: DataFrame, width: int = 6) -> DataFrame:
    """(doc_id, item_id, offset, votes, covered, n_words): the diagonal on which an item lies best in a document.

    Posting probes join n-grams of words by their text.  ``offset`` is the document's place less the item's, ``votes`` the grams on
    it, ``covered`` the item's words that those grams cover; most covered words, then the smallest offset wins.
    Covered words are counted from the gaps between neighbouring grams, so no word list is gathered.
    """
    def grams(df: DataFrame, key: str) -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")
        each = df.select(key, words.alias("w")).where(F.size("w") >= width)
        return each.select(key, F.size("w").alias("n_words"), F.posexplode(F.expr(f"transform(sequence(1, size(w) - {width - 1}), i -> array_join(slice(w, i, {width}), ' '))")).alias("at", "gram"))

    met = grams(docs, "doc_id").drop("n_words").withColumnRenamed("at", "d_at").join(grams(items, "item_id"), "gram").select("doc_id", "item_id", "n_words", "at", (F.col("d_at") - F.col("at")).alias("offset"))
    line = ["doc_id", "item_id", "n_words", "offset"]
    before = F.lag("at").over(Window.partitionBy(*line).orderBy("at"))
    new = F.least(F.lit(width), F.coalesce(F.col("at") - F.col("before"), F.lit(width)))
    lines = met.withColumn("before", before).groupBy(*line).agg(F.count("*").alias("votes"), F.sum(new).alias("covered"))
    best = F.max(F.struct("covered", (-F.col("offset")).alias("o"), "votes")).alias("b")
    return lines.groupBy("doc_id", "item_id", "n_words").agg(best).select("doc_id", "item_id", (-F.col("b.o")).alias("offset"), "b.votes", "b.covered", F.col("n_words").cast("long").alias("n_words"))
