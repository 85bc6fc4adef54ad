"""Tokens of two tokenizers over the same bytes: which of them overlap, which end together, and how often.

A encodes a space and the text, B the text, to which it adds that space itself.  Byte offsets where tokens of both end
cut the tokens into groups; a link is a pair of tokens, one of each, that end together.  Texts that are null or empty, or whose
joined token bytes differ from space and text, have no tokens.

A task takes some megabytes of text at a time, cuts them where both tokenizers certainly cut (a single space
between characters that aren't white space) and gives the distinct segments to DuckDB as token interval tables: ASOF joins find the first and
the last token of B that a token of A meets, a range join the overlaps between them, window sums number the groups.
Pair counts are partial sums, merged by Spark.  Two linked tokens end together, so one is a suffix of the other: the two
vocabularies bound the number of pairs (``most_pairs``), whatever the corpus.

Extra columns are not read but the id, which may repeat or be null; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, give_back, resident, staged

CHUNK = 4_000_000  # characters that a task aligns at once
AT_ONCE = 8192  # segments that the tokenizers get at once
TOGETHER = 64  # neighbouring segments that A encodes as one text
ROWS = 512  # rows handed to Python at once
#: White space of any definition, and format characters near it: next to these a space is no certain cut.
_BLANK = r"\s\x00-\x1f\x85\xa0 ᠎ -‏    ⁠▁　﻿"
_BLANKS = frozenset(re.findall(f"[{_BLANK}]", "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x10000)))))
_CUT = re.compile(rf" (?<=[^{_BLANK}] )(?=[^{_BLANK}])")
_SCHEMA = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups string, pair_a array<int>, pair_b array<int>, pair_n array<long>"


@dataclass(frozen=True)
class Ids:
    """Token ids of many parts end to end, and how many each part has."""

    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def none(cls) -> Ids:
        return cls(np.empty(0, np.int32), np.empty(0, np.int64))

    def __add__(self, other: Ids) -> Ids:
        return Ids(np.concatenate([self.flat, other.flat]), np.concatenate([self.sizes, other.sizes]))

    def of(self, keep: np.ndarray) -> Ids:
        return Ids(self.flat[np.repeat(keep, self.sizes)], self.sizes[keep])


def _of_lists(lists: list[list[int]]) -> Ids:
    return Ids(np.fromiter(chain.from_iterable(lists), np.int32), np.array([len(x) for x in lists], np.int64))


def _spell(ids: Ids, spelt: list[bytes], sizes: np.ndarray, raws: list[bytes]) -> np.ndarray:
    """Whether the tokens of each part spell its bytes: at once where all do, part by part else."""
    flat, ends = ids.flat.tolist(), np.cumsum(ids.sizes)
    bytes_at = np.append(0, np.cumsum(sizes[ids.flat]))
    if np.array_equal(bytes_at[ends], np.cumsum([len(r) for r in raws])) and b"".join([spelt[i] for i in flat]) == b"".join(raws):
        return np.ones(len(raws), bool)
    return np.array([b"".join([spelt[i] for i in flat[e - n : e]]) == raw for e, n, raw in zip(ends.tolist(), ids.sizes.tolist(), raws, strict=True)])


class Pair:
    """The two tokenizers, with the bytes of each token."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings inside a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        letters = byte_letters()
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.vocab_size())]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in spelt], np.int64) for spelt in (self.bytes_a, self.bytes_b))
        self.cuts = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))

    def segments(self, text: str) -> list[str]:
        """The text in parts that both tokenizers encode on their own; each but the first follows a space."""
        return _CUT.split(text) if self.cuts else [text]

    def encoded(self, parts: list[str]) -> tuple[Ids, Ids, np.ndarray]:
        """Ids of both tokenizers for each part, and whether both give back its bytes.

        The libraries' own objects for a part take many times its size, so they see ``AT_ONCE`` parts at a time."""
        a, b, same = Ids.none(), Ids.none(), [np.empty(0, bool)]
        for low in range(0, len(parts), AT_ONCE):
            some = parts[low : low + AT_ONCE]
            raws = [b" " + p.encode() for p in some]
            more_a, more_b = self._of_a(some, raws), _of_lists(self.b.encode(some, num_threads=1))
            same.append(_spell(more_a, self.bytes_a, self.sizes_a, raws) & _spell(more_b, self.bytes_b, self.sizes_b, raws))
            a, b = a + more_a, b + more_b
        return a, b, np.concatenate(same)

    def _of_a(self, some: list[str], raws: list[bytes]) -> Ids:
        """A's ids of each part.  Parts between which a cut is certain are encoded together and told apart by their bytes."""
        units, run = [], []
        for p in some:
            plain = p and p[0] not in _BLANKS and p[-1] not in _BLANKS
            if run and (not plain or len(run) == TOGETHER):
                units.append(" " + " ".join(run))
                run = []
            if plain and self.cuts:
                run.append(p)
            else:
                units.append(" " + p)
        if run:
            units.append(" " + " ".join(run))
        flat = _of_lists([e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]).flat
        ends = np.cumsum(self.sizes_a[flat])
        wanted = np.cumsum([len(r) for r in raws])
        at = np.searchsorted(ends, wanted)
        if len(ends) and ends[-1] == wanted[-1] and np.array_equal(ends[at], wanted):
            return Ids(flat, np.diff(at + 1, prepend=0))
        return _of_lists([e.ids for e in self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False)])

    def most_pairs(self) -> int:
        """An upper bound of the pairs of ids that can end together: each suffix of a token, times the tokens that spell it."""
        spelt_a, spelt_b = _spellings(self.bytes_a), _spellings(self.bytes_b)
        return sum(n * spelt_b.get(s[i:], 0) for s, n in spelt_a.items() for i in range(len(s))) + sum(n * spelt_a.get(s[i:], 0) for s, n in spelt_b.items() for i in range(1, len(s)))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others
    from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _piece_bytes(piece: str) -> bytes:
    if m := re.fullmatch(r"<0x([0-9A-F]{2})>", piece):
        return bytes([int(m[1], 16)])
    return piece.replace("▁", " ").encode()


def _spellings(tokens: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for t in tokens:
        out[t] = out.get(t, 0) + 1
    return out


def _intervals(ids: Ids, spelt: np.ndarray) -> pa.Table:
    """(n, part, id, s, e): tokens in order, each with the bytes it covers, over all parts end to end."""
    sizes = spelt[ids.flat]
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(ids.sizes), dtype=np.int32), ids.sizes)
    return pa.table({"n": np.arange(len(sizes), dtype=np.int64), "part": part, "id": ids.flat, "s": ends - sizes, "e": ends})


#: Overlapping pairs (an, bn), and whether they end together.  Parts lie end to end, so no pair crosses from one to the next.
_OVERLAPS = """CREATE OR REPLACE TEMP TABLE shared AS
WITH first AS (SELECT a.n, a.s, a.e, b.n AS low FROM a ASOF JOIN b ON a.s >= b.s),
reach AS (SELECT f.n, f.s, f.e, f.low, b.n AS high FROM first f ASOF JOIN b ON f.e > b.s),
cover AS (SELECT n AS an, s, e, unnest(range(low, high + 1)) AS bn FROM reach)
SELECT an, bn, cover.e = b.e AS link FROM cover JOIN b ON b.n = cover.bn"""
#: Tokens of one side with the number of their group: a new one starts after each token that ends together with one of the other side.
_GROUPED = """SELECT t.n, t.part, t.id, coalesce(sum(CASE WHEN l.n IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY t.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
FROM {side} t LEFT JOIN (SELECT {side}n AS n FROM shared WHERE link) l ON l.n = t.n"""


def _duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})  # no files of its own
    con.execute("SET enable_progress_bar = false")
    return con


class Aligned:
    """The alignment of some parts, as tables of one DuckDB connection."""

    def __init__(self, con: duckdb.DuckDBPyConnection, pair: Pair, ids_a: Ids, ids_b: Ids):
        self.con, self.ids = con, {"a": ids_a, "b": ids_b}
        for side, spelt in (("a", pair.sizes_a), ("b", pair.sizes_b)):
            con.register("arrow", _intervals(self.ids[side], spelt))
            con.execute(f"CREATE OR REPLACE TEMP TABLE {side} AS SELECT * FROM arrow")
            con.unregister("arrow")
        con.execute(_OVERLAPS)
        for side in "ab":
            con.execute(f"CREATE OR REPLACE TEMP TABLE g{side} AS {_GROUPED.format(side=side)}")
        con.execute("CREATE OR REPLACE TEMP TABLE links AS SELECT a.part, a.id AS a, b.id AS b, count(*) AS n FROM shared o JOIN a ON a.n = o.an JOIN b ON b.n = o.bn WHERE o.link GROUP BY ALL")

    def strings(self) -> tuple[pa.Array, np.ndarray]:
        """The groups of each part as one string, and how many it has."""
        sides, first = [], None
        for side in "ab":
            grp = self.con.sql(f"SELECT CAST(grp AS BIGINT) AS grp FROM g{side} ORDER BY n").fetchnumpy()["grp"]
            starts = np.flatnonzero(np.diff(grp, prepend=-1))
            sides.append(_joined(pc.cast(pa.array(self.ids[side].flat), pa.string()), np.append(starts, len(grp)), ","))
            first = starts if side == "a" else first
        part = np.repeat(np.arange(len(self.ids["a"].sizes)), self.ids["a"].sizes)[first]
        counts = np.bincount(part, minlength=len(self.ids["a"].sizes))
        return _joined(pc.binary_join_element_wise(*sides, "|"), np.append(0, np.cumsum(counts)), ";"), counts

    def pairs_of(self, docs: np.ndarray, parts: np.ndarray) -> pa.Table:
        """(doc, a, b, n): how often each linked pair of ids occurs in each document of the occurrences (doc, part)."""
        self.con.register("occurrences", pa.table({"doc": docs, "part": parts}))
        got = self.con.sql(
            "SELECT doc, a, b, CAST(sum(k * n) AS BIGINT) AS n FROM (SELECT doc, part, count(*) AS k FROM occurrences GROUP BY doc, part) JOIN links USING (part) GROUP BY doc, a, b ORDER BY doc, b, a"
        ).to_arrow_table()
        self.con.unregister("occurrences")
        return got


def _joined(words: pa.Array, cuts: np.ndarray, between: str) -> pa.Array:
    """The strings between neighbouring cuts joined to one each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), words), between)


class _Chunk:
    """Documents that one task aligns together: their distinct segments, and which document holds which."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        self.pair, self.n = pair, len(texts)
        cut = [pair.segments(t) if t else [] for t in texts]
        known: dict[str, int] = {}
        codes = [[known.setdefault(s, len(known)) for s in segments] for segments in cut]
        ids_a, ids_b, same = pair.encoded(list(known))
        if not same.all():  # bytes are judged on whole texts: those with such a segment are encoded as one
            bad = set(np.flatnonzero(~same).tolist())
            whole = [i for i, c in enumerate(codes) if not bad.isdisjoint(c)]
            more_a, more_b, fine = pair.encoded([texts[i] for i in whole])
            for k, i in enumerate(whole):
                codes[i] = [len(same) + k] if fine[k] else []
            ids_a, ids_b, same = ids_a + more_a, ids_b + more_b, np.concatenate([same, fine])
        place = np.cumsum(same) - 1
        self.n_parts, self.a, self.b = int(same.sum()), ids_a.of(same), ids_b.of(same)
        sizes = [len(c) for c in codes]
        self.docs = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.codes = place[np.fromiter(chain.from_iterable(codes), np.int64, sum(sizes))].astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def total(self, each: np.ndarray) -> np.ndarray:
        """Sums of a number of each segment over each document."""
        return np.bincount(self.docs, weights=each[self.codes], minlength=self.n).astype(np.int64) if len(self.codes) else np.zeros(self.n, np.int64)


def _documents(chunk: _Chunk, con: duckdb.DuckDBPyConnection) -> list[pa.Array]:
    """n_a, n_b, n_groups, n_links, groups and the pair lists of each document of the chunk."""
    n = chunk.n
    if not chunk.n_parts:
        none = pa.array([[]] * n, pa.list_(pa.int32()))
        zeros = pa.array(np.zeros(n, np.int64))
        return [zeros, zeros, zeros, zeros, pa.array([""] * n), none, none, pa.array([[]] * n, pa.list_(pa.int64()))]
    table = Aligned(con, chunk.pair, chunk.a, chunk.b)
    strings, groups = table.strings()
    pairs = table.pairs_of(chunk.docs, chunk.codes)
    texts = _joined(strings.take(pa.array(chunk.codes)), chunk.starts, ";")
    doc, count = pairs["doc"].to_numpy(), pairs["n"].to_numpy()
    cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, pairs[c].combine_chunks().cast(t)) for c, t in (("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()))]
    links = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
    return [pa.array(chunk.total(chunk.a.sizes)), pa.array(chunk.total(chunk.b.sizes)), pa.array(chunk.total(groups)), pa.array(links), texts, *lists]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of the batches, CHUNK characters at a time, or one longer text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        keys = batch.column(0)
        for i, text in enumerate(batch.column(1).to_pylist()):
            if texts and size + len(text or "") > CHUNK:
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
            ids.append(keys.slice(i, 1))
            texts.append(text)
            size += len(text or "")
    if texts:
        yield pa.concat_arrays(ids), texts


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """One staged row for each document: doc_id, n_a, n_b, n_groups, n_links, groups, and its linked pairs of ids with their number.

    ``groups`` writes each group as A's ids, a bar and B's ids, groups apart by semicolons; with ``digest`` its
    SHA-256 in hexadecimal stands in its place, ``groups_sha256``, and '' where there are no tokens.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = resident(("align", path_a, path_b), lambda: Pair(path_a, path_b))
        con = _duck()
        try:
            for ids, texts in _chunks(batches):
                columns = _documents(_Chunk(pair, texts), con)
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pair_a", "pair_b", "pair_n"]
                whole = pa.table([ids, *columns], names=names)
                yield from whole.to_batches(max_chunksize=256)
                del columns, whole
                give_back()
        finally:
            con.close()

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(part, _SCHEMA.format(id=kind))
    if digest:
        sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        rows = rows.withColumn("groups", sha).withColumnRenamed("groups", "groups_sha256")
    with batches_of(spark, ROWS):
        return staged(rows, "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n): how many links of the corpus hold each pair of ids; the partial counts of documents are summed before the shuffle."""
    pairs = rows.select(F.inline(F.arrays_zip("pair_a", "pair_b", "pair_n"))).toDF("a", "b", "k")
    return pairs.groupBy("a", "b").agg(F.sum("k").alias("n"))


def with_pair_counts(rows: DataFrame) -> DataFrame:
    """Adds ``count_sum``, the corpus-wide counts of a document's links summed, and ``n_best``, the links whose count is the highest of their B id.

    The counts go to the tasks as arrays; the vocabularies bound their size, see ``most_pairs``.
    """
    got = pair_counts(rows).toArrow()
    a, b, n = (got[c].to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    keys = (a << 32) | b
    order = np.argsort(keys)
    keys, b, n = keys[order], b[order], n[order]
    highest = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
    np.maximum.at(highest, b, n)
    best = n == highest[b]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("pair_a", "pair_b", "pair_n")]
            x, y, k = (v.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for v in lists)
            at = np.searchsorted(keys, (x << 32) | y)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, doc, n[at] * k)
            np.add.at(bests, doc, best[at] * k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bests), pa.array(sums)], [*batch.schema.names, "n_best", "count_sum"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(part, f"{schema}, n_best long, count_sum long").drop("pair_a", "pair_b", "pair_n")


def overlaps(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each pair of tokens that share bytes: doc_id, the place of both among the document's tokens,
    their ids, the bytes of space and text where the shared ones begin and end, and whether both end together."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = resident(("align", path_a, path_b), lambda: Pair(path_a, path_b))
        con = _duck()
        try:
            for ids, texts in _chunks(batches):
                chunk = _Chunk(pair, texts)
                if not chunk.n_parts:
                    continue
                Aligned(con, pair, chunk.a, chunk.b)
                con.register("occurrences", pa.table({"k": np.arange(len(chunk.codes)), "doc": chunk.docs, "part": chunk.codes}))
                got = con.sql(_PLACED).to_arrow_table()
                con.unregister("occurrences")
                out = pa.table([ids.take(got["doc"].combine_chunks()), *[got[c] for c in got.schema.names[1:]]], names=["doc_id", *got.schema.names[1:]])
                yield from out.to_batches(max_chunksize=65_536)
        finally:
            con.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {kind}, place_a long, place_b long, a int, b int, start long, end long, link boolean")


#: The overlaps of distinct segments moved to each document that holds them: window sums over its segments give the tokens and bytes before.
_PLACED = """WITH sizes AS (SELECT x.part, na, nb, low_a, low_b, s, e FROM (SELECT part, count(*) AS na, min(n) AS low_a, min(s) AS s, max(e) AS e FROM a GROUP BY part) x
    JOIN (SELECT part, count(*) AS nb, min(n) AS low_b FROM b GROUP BY part) y USING (part)),
placed AS (SELECT o.k, o.doc, o.part, sum(na) OVER w - na - low_a AS add_a, sum(nb) OVER w - nb - low_b AS add_b, sum(e - s) OVER w - (e - s) - s AS add_s
    FROM occurrences o JOIN sizes USING (part) WINDOW w AS (PARTITION BY o.doc ORDER BY o.k ROWS UNBOUNDED PRECEDING))
SELECT p.doc, CAST(v.an + p.add_a AS BIGINT) AS place_a, CAST(v.bn + p.add_b AS BIGINT) AS place_b, a.id AS a, b.id AS b, CAST(greatest(a.s, b.s) + p.add_s AS BIGINT) AS start, CAST(least(a.e, b.e) + p.add_s AS BIGINT) AS "end", v.link
FROM shared v JOIN a ON a.n = v.an JOIN b ON b.n = v.bn JOIN placed p ON p.part = a.part"""
