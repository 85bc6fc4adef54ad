"""Token ids as binary blocks coded by a static range asymmetric numeral system (rANS).

Texts are encoded by a public tokenizer, each document ends with the end id, and the ids follow one
another in ascending order of doc_id.  Blocks hold whole documents; one shared frequency table codes all
of them.  In a block, id i belongs to lane i mod LANES, and the lanes' coders are interleaved in one
stream of 32-bit words.  Every CHECK steps a checkpoint gives the lanes' states, the place in the stream and a
checksum, so blocks, and the segments of a block, can be decoded on their own and in parallel.

Block (little endian): magic 4s, version u16, lanes u16, ids u32, documents u32, segments u32, words u32;
documents' lengths u32; for each segment first word u32, crc32 of its ids as u32 LE, states u64 x lanes; words u32.

Defined results: null and empty texts are the end id alone; equal ids are ordered by text; null ids come
first; an empty table writes no block and reads back no row; a text of any length stays in one block.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, drop_staged, give_back, key_splits, new_path, parallelism, range_of, resident, staged

END = 1
BLOCK = 1 << 18  # ids after which a block ends with the document
LANES = 1024
CHECK = 128  # steps of all lanes between two checkpoints
BITS = 18  # the frequencies of the table add up to 2 to this power
LOW = 1 << 31
MAGIC, HEAD = b"RANS", struct.Struct("<4sHHIIII")
_ROWS = 512  # texts that Python gets at once
_BYTES = 1 << 20  # texts are encoded together up to this size
_CACHE = 5 << 16  # pieces whose ids a worker keeps; beyond, those met in one batch only go
_PAGES = {"parquet.page.size.row.check.min": "1"}  # rows are large: a page, and the buffers that code it, hold one or few
_BLOCKS = 8  # rows of ids or blocks that Python gets at once
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


def _byte_classes() -> np.ndarray:
    """The class of each byte of UTF-8.  Letters are a-z and U+00C0 to U+024F; bytes that follow are letters as well,
    so what they belong to hangs on the first.  A run with _OTHER bytes is left whole."""
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[33:127] = _MARK
    kinds[[*b"'<"]] = _OTHER
    kinds[[*b"0123456789"]] = _DIGIT
    kinds[[*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
    kinds[[*b" \t\n\v\f\r"]] = _SPACE
    return kinds


_CLASS = _byte_classes().tobytes()
_LOWER = bytes(range(256)).lower()
_BLANK = b" \t\n\v\f\r"
_MARKS = re.compile(r"[!-/:-@\[-`{-~]+")
_LATIN = re.compile("[\0-\u012f\u0131-\u024f]+")  # without the capital i with a dot, which becomes two characters


def _odd(text: str) -> bool:
    """Whether lowering A-Z first could make a special token of it, or leave a letter in two parts that the
    tokenizer composes before it lowers: U+0300 to U+037F holds all that composes with an ASCII letter."""
    raw = text.encode("utf-8", "replace")
    return b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw


def _pieces(raw: np.ndarray, ends: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of texts that stand one after another in ``raw`` up to ``ends``, and the number of each text's.

    White space parts pieces, and so do changes between letters, ASCII punctuation and single digits."""
    low = raw.tobytes().translate(_LOWER)
    kind = np.frombuffer(bytearray(low.translate(_CLASS)), np.uint8)
    for first, second in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)):  # signs among the letters, and the capital i with a dot, which ends in a mark
        at = np.flatnonzero(raw[:-1] == first) + 1
        kind[at[raw[at] == second]] = _OTHER
    kept = kind != _SPACE
    fresh = np.ones(len(raw) + 1, bool)  # bytes that begin a run, and white space
    np.logical_not(kept[:-1], out=fresh[1:-1])
    fresh[ends] = True
    cut = fresh[:-1] | (kind == _DIGIT)
    cut[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(cut & kept)
    if len(other := np.flatnonzero(kind == _OTHER)):
        first = fresh[starts]
        run = np.cumsum(first, dtype=np.int32)
        whole = np.zeros(int(run[-1]) + 1, bool)
        whole[run[np.searchsorted(starts, other, "right") - 1]] = True
        starts = starts[first | ~whole[run]]
    data = low.translate(None, _BLANK)
    offsets = np.append(np.cumsum(kept, dtype=np.int32)[starts] - np.int32(1), np.int32(len(data)))
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return found, np.diff(np.searchsorted(starts, ends), prepend=0)


class _Letters(dict):
    """What normalizing and splitting make of single letters, by their code points, as str.translate asks."""

    def __init__(self, steps: Callable):
        self.steps = steps

    def __missing__(self, letter: int) -> str:
        self[letter] = got = "".join(x for x, _ in self.steps(chr(letter)))
        return got


class Encoder:
    """Ids of texts from the tokenizers library.

    ``parted`` says that the tokenizer parts a text at white space and between letters, single digits and other marks,
    and takes letters in lower case; then each distinct piece is encoded once and its ids are kept.  Else whole
    texts are encoded."""

    def __init__(self, path: str, parted: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.parted = Tokenizer.from_file(path), parted
        self.model = self.tokenizer.model
        normalize, split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.steps = lambda text: split(normalize(text))
        self.letters = _Letters(self.steps)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}  # numbers of pieces
        self.flat, self.start, self.count, self.met = np.empty(1 << 16, np.uint32), *(np.empty(1 << 14, t) for t in (np.int64, np.int64, np.int32))
        self.used = 0
        self._keep([" "], np.array([1]), np.array([END]))  # a document's end

    def _forget(self) -> None:
        """Keeps the pieces met in several batches, if those are few enough."""
        words, k = list(self.known), len(self.known)
        stays = np.flatnonzero(self.met[:k] > 1)
        stays = stays[stays > 0]
        n, ids, met = self.count[stays], self._gather(stays), self.met[stays] // 2
        self._clear()
        if len(stays) < _CACHE // 2:
            own = self._keep([words[i] for i in stays.tolist()], n, ids)
            self.met[own] = met

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many, ids one after another) that the library gives each piece: from its model alone where normalizing
        and splitting leave the piece as it is or go letter by letter, else by its steps one after another."""
        n, out, tokenize, letters = [], [], self.model.tokenize, self.letters
        for w in words:
            if w.isascii() and (w.isalnum() or _MARKS.fullmatch(w) and "'" not in w):
                got = [t.id for t in tokenize(w)]
            elif w.isalpha() and _LATIN.fullmatch(w):
                got = [t.id for t in tokenize(w.translate(letters))]
            else:
                got = [t.id for x, _ in self.steps(w) for t in tokenize(x)]
            n.append(len(got))
            out += got
        return np.array(n, np.int64), np.array(out, np.uint32)

    def _keep(self, words: list[str], n: np.ndarray, ids: np.ndarray) -> slice:
        """Takes new pieces and their ids, one after another; the numbers that the pieces get."""
        own = slice(len(self.known), len(self.known) + len(words))
        self.known.update(zip(words, range(own.start, own.stop), strict=True))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while own.stop > len(self.start):
            self.start, self.count, self.met = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.count, self.met))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[own] = self.used + np.cumsum(n) - n
        self.count[own] = n
        self.met[own] = 0
        self.used += len(ids)
        return own

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of known words, one after another."""
        n = self.count[at]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[at] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of texts, one after another, each with the end id.

        Arrow numbers the distinct pieces, so Python sees each piece of the batch once."""
        if not self.parted:
            return self._whole(texts.to_pylist())
        texts = pa.concat_arrays([texts]) if texts.offset else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        if ((raw == 0xCC) | (raw == 0xCD)).any() or ((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)).any():
            plain = texts.to_pylist()
            if odd := [i for i, t in enumerate(plain) if _odd(t)]:
                return self._around(plain, odd)
        found, per = _pieces(raw, offsets[1:] - offsets[0])
        coded = found.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes ten times as long
        if len(self.known) + len(words) > _CACHE:
            self._forget()
        own = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(own < 0)):
            fresh = [words[i] for i in new.tolist()]
            took = self._keep(fresh, *self._ids(fresh))
            own[new] = np.arange(took.start, took.stop)
        self.met[own] += 1
        at = np.insert(own[np.asarray(coded.indices)] if len(words) else np.empty(0, np.int64), np.cumsum(per), self.known[" "])
        ends = np.cumsum(self.count[at])[np.cumsum(per + 1) - 1]
        return self._gather(at), np.diff(ends, prepend=0)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [[*e.ids, END] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)

    def _around(self, texts: list[str], odd: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_all: the library takes the odd texts as they are."""
        rest = sorted(set(range(len(texts))).difference(odd))
        own, theirs = self.encode_all(pa.array([texts[i] for i in rest], pa.string())), self._whole([texts[i] for i in odd])
        parts: list = [None] * len(texts)
        for places, (ids, lengths) in ((rest, own), (odd, theirs)):
            for i, part in zip(places, np.split(ids, np.cumsum(lengths)[:-1]), strict=True) if places else ():
                parts[i] = part
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


def encoder(path: str, parted: bool) -> Encoder:
    return resident(("encoder", path, parted), lambda: Encoder(path, parted))


def frequencies(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, frequencies): every id that occurs gets at least 1, and all add up to 2**BITS."""
    ids = np.array(sorted(counts), np.uint32)
    n = np.array([counts[int(i)] for i in ids], np.float64)
    if len(ids) >= 1 << BITS:
        raise ValueError(f"{len(ids)} different ids; the table has room for {(1 << BITS) - 1}")
    room = (1 << BITS) - len(ids)
    share = n / n.sum() * room if len(ids) else n
    freq = np.floor(share).astype(np.int64) + 1
    left = (1 << BITS) - int(freq.sum()) if len(ids) else 0
    freq[np.argsort(-(share - np.floor(share)), kind="stable")[:left]] += 1
    return ids, freq.astype(np.uint64)


class Table:
    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids, freq
        self.cum = np.cumsum(freq) - freq
        self.place = np.zeros(int(ids[-1]) + 1 if len(ids) else 1, np.int64)
        self.place[ids] = np.arange(len(ids))
        self.slot = np.repeat(np.arange(len(ids), dtype=np.uint32), freq.astype(np.int64))
        self.limit = freq << np.uint64(63 - BITS)

    def encode(self, ids: np.ndarray, lengths: np.ndarray) -> bytes:
        """A block of the ids of whole documents."""
        sym = self.place[ids]
        steps = -(-len(ids) // LANES)
        padded = np.zeros(steps * LANES, np.int64)
        padded[: len(ids)] = sym
        freq, cum, limit = (x[padded].reshape(steps, LANES) for x in (self.freq, self.cum, self.limit))
        live = LANES - (steps * LANES - len(ids))  # lanes in use in the last step
        x = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        segments, size = [], []
        for s in range(steps - 1, -1, -1):
            k = live if s == steps - 1 else LANES
            f, y = freq[s, :k], x[:k]
            full = np.flatnonzero(y >= limit[s, :k])
            moved = y[full]
            words.append(moved.astype(np.uint32))  # the low 32 bits
            y[full] = moved >> np.uint64(32)
            q = y // f
            y -= q * f
            q <<= np.uint64(BITS)
            y += q
            y += cum[s, :k]
            if s % CHECK == 0:
                segments.append((s, x.copy()))
        words.reverse()
        size = np.concatenate(([0], np.cumsum([len(w) for w in words]))) if words else np.zeros(1, np.int64)
        stream = np.concatenate(words) if words else np.empty(0, np.uint32)
        little = ids.astype("<u4")
        out = [HEAD.pack(MAGIC, 1, LANES, len(ids), len(lengths), len(segments), len(stream)), lengths.astype("<u4").tobytes()]
        for s, states in reversed(segments):
            out += [struct.pack("<II", int(size[s]), zlib.crc32(little[s * LANES : (s + CHECK) * LANES])), states.astype("<u8").tobytes()]
        return b"".join([*out, stream.astype("<u4").tobytes()])

    def parts(self, block: bytes) -> tuple[np.ndarray, list[tuple], np.ndarray, int]:
        """Lengths of the documents, segments (first word, crc32, states), words and number of ids of a block."""
        magic, version, lanes, n, docs, segments, words = HEAD.unpack_from(block)
        if magic != MAGIC or version != 1:
            raise ValueError("not a block of this format")
        at = HEAD.size
        lengths = np.frombuffer(block, "<u4", docs, at)
        at += 4 * docs
        found = []
        for _ in range(segments):
            first, crc = struct.unpack_from("<II", block, at)
            found.append((first, crc, np.frombuffer(block, "<u8", lanes, at + 8).astype(np.uint64)))
            at += 8 + 8 * lanes
        return lengths, found, np.frombuffer(block, "<u4", words, at), n

    def segment(self, segment: tuple, words: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of one segment, checked against its checksum."""
        at, crc, x = segment[0], segment[1], segment[2].copy()
        lanes = len(x)
        steps = -(-n // lanes)
        out = np.empty(steps * lanes, np.uint32)
        mask, bits, low, thirty2 = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(LOW), np.uint64(32)
        for s in range(steps):
            k = min(lanes, n - s * lanes)
            y = x[:k]
            slot = y & mask
            r = self.slot[slot]
            out[s * lanes : s * lanes + k] = r
            y = self.freq[r] * (y >> bits) + slot - self.cum[r]
            need = np.flatnonzero(y < low)
            if m := len(need):
                y[need] = (y[need] << thirty2) | words[at : at + m].astype(np.uint64)
                at += m
            x[:k] = y
        ids = self.ids[out[:n]]
        if zlib.crc32(ids.astype("<u4")) != crc:
            raise ValueError("a segment's checksum differs")
        return ids

    def decode(self, block: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(lengths of the documents, ids) of a block."""
        lengths, segments, words, n = self.parts(block)
        step = CHECK * LANES
        ids = [self.segment(s, words, min(step, n - i * step)) for i, s in enumerate(segments)]
        return lengths, np.concatenate(ids) if ids else np.empty(0, np.uint32)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with texts of about _BYTES, or one that is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + _BYTES, "right")))
        yield b.slice(at, upto - at)
        at = upto


def tokenized(docs: DataFrame, tokenizer: str, parted: bool = True) -> DataFrame:
    """Blocks of plain ids: (part, first, doc_ids, lengths, ids as u32 LE): first counts the ids before, in the part.

    Texts are shuffled once, by ranges of doc_id."""
    splits = key_splits(docs, "doc_id", parallelism(docs.sparkSession))
    ordered = (
        docs.select(range_of(F.col("doc_id"), splits).alias("part"), "doc_id", "text")
        .repartitionById(len(splits) + 1, "part")
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, docs_, sizes, n, first, now = encoder(tokenizer, parted), [], [], [], 0, 0, None

        def flush() -> pa.RecordBatch:
            row = ([now], [first], [docs_], [sizes], [np.concatenate(held).astype("<u4").tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        for b in (part for b in batches for part in _slices(b)):
            parts, doc_ids = b.column(0).to_numpy().tolist(), b.column(1).to_pylist()
            ids, lengths = enc.encode_all(pc.fill_null(b.column(2), ""))
            ends, cut = np.cumsum(lengths).tolist(), 0
            for i, (k, doc_id, size) in enumerate(zip(parts, doc_ids, lengths.tolist(), strict=True)):
                if docs_ and (k != now or n >= BLOCK):
                    held.append(ids[cut : ends[i] - size])
                    cut = ends[i] - size
                    yield flush()
                    first = first + n if k == now else 0
                    held, docs_, sizes, n = [], [], [], 0
                now = k
                docs_.append(doc_id)
                sizes.append(size)
                n += size
            held.append(ids[cut:])
        if docs_:
            yield flush()
        give_back()

    names = ["part", "first", "doc_ids", "lengths", "ids"]
    types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return ordered.mapInArrow(run, "part int, first long, doc_ids array<long>, lengths array<long>, ids binary")


def write(docs: DataFrame, path: str, tokenizer: str, parted: bool = True) -> None:
    """Writes ``docs`` (doc_id, text): path/table has the shared frequencies, path/blocks the coded blocks."""
    spark = docs.sparkSession
    with batches_of(spark, _ROWS):
        plain = staged(tokenized(docs, tokenizer, parted), "ids", _PAGES)
    with batches_of(spark, _BLOCKS):
        _write(plain, path)
    drop_staged(plain)


def _write(plain: DataFrame, path: str) -> None:
    spark = plain.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 16, np.int64)
        for b in batches:
            for raw in b.column(0):
                n = np.bincount(np.frombuffer(raw.as_buffer(), "<u4"), minlength=len(sums))
                n[: len(sums)] += sums
                sums = n
        ids = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums[ids], pa.int64())], ["id", "n"])

    # as many rows as the tokenizer has ids
    counts = {r["id"]: r["n"] for r in plain.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    ids, freq = frequencies(counts)
    spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, freq, strict=True)], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")

    total, start = 0, {}
    sizes = plain.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    for r in sizes.orderBy("part").collect():  # a row for each part
        start[r["part"]] = total
        total += r["n"]
    table_args = (ids, freq)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = resident(("table", path), lambda: Table(*table_args))
        for b in batches:
            for i, (part, first, lengths, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4), strict=True)):
                block = table.encode(np.frombuffer(raw.as_buffer(), "<u4"), lengths.values.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start[part] + first], pa.int64()), b.column(2).slice(i, 1), pa.array([zlib.crc32(block)], pa.int64()), pa.array([block], pa.binary())], ["part", "start", "doc_ids", "crc32", "block"])

    coded = plain.select("part", "first", "doc_ids", "lengths", "ids").mapInArrow(code, "part int, start long, doc_ids array<long>, crc32 long, block binary")
    coded.write.options(**_PAGES, compression="none").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r["id"], r["freq"]) for r in spark.read.parquet(f"{path}/table").collect())
    return np.array([r[0] for r in rows], np.uint32), np.array([r[1] for r in rows], np.uint64)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files of ``write``; ids as u32 LE."""
    table_args = read_table(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = resident(("table", path), lambda: Table(*table_args))
        for b in batches:
            for start, doc_ids, crc, block in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if zlib.crc32(block) != crc:
                    raise ValueError("a block's checksum differs")
                lengths, ids = table.decode(block)
                little, ends = ids.astype("<u4"), np.cumsum(lengths, dtype=np.int64)
                each = [little[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(start + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(x) for x in each], pa.int64()), *([pa.array(each, pa.binary())] if with_ids else [])],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4],
                )

    blocks = spark.read.schema("part int, start long, doc_ids array<long>, crc32 long, block binary").parquet(f"{path}/blocks")
    return blocks.select("start", "doc_ids", "crc32", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, parted: bool = True) -> DataFrame:
    """Writes ``docs`` into the shared folder and reads the files back, without the ids themselves."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, parted)
    return read(docs.sparkSession, path, with_ids=False)
