"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector.  An n-gram's vector binds (multiplies) the vectors of its
letters, each permuted (rotated) by its place; a text's vector bundles (adds) those of its n-grams;
a language's prototype bundles its training texts.  A text gets the language whose prototype has the
highest cosine with the text's vector.  Bundling is linear, so texts and prototypes are built from
n-gram counts, and only n-grams that occur are ever bound.

Defined results: null text, empty text and text without a letter give ``und`` with score 0; ties go
to the smaller language name; with no training row every text gives ``und``; a language without any
letter in its texts has no prototype; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import give_back, resident

DIM = 1024
GRAM = 3
SLOTS = 64  # a worker's first letters, a to z among them, have n-grams in a table; those with later letters in a dict
SEED = 20240229
UNKNOWN = "und"
_CHUNK = 1 << 18  # characters of a text that are counted at once
_ROWS = 1 << 15  # n-gram vectors that a worker keeps
_SLICE = 1 << 12  # n-grams that are bundled at once
_EXACT = 1 << 24  # single precision adds up to here without rounding
_WIDE = np.int64(1) << np.int64(60)


class Space:
    """Letter vectors and the n-gram vectors bound so far, at most _ROWS; one for each Python worker.

    Each letter has its own vector, drawn from a generator seeded by its code point, so workers agree; a
    worker numbers letters as it meets them, and its numbers never leave it."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letters: list[np.ndarray] = [self._vector(0)]  # the gap between words
        self.slot_of: dict[int, int] = {}
        self.ascii = np.zeros(128, np.int32)
        for c in range(97, 123):
            self.ascii[c] = self.ascii[c - 32] = self._slot(c)
        self.wide: dict[int, int] = {}
        self.bound = np.zeros((_ROWS, dim), np.int8)
        self._clear()

    def _clear(self) -> None:
        self.at, self.far, self.used = np.full(SLOTS**GRAM, -1, np.int32), {}, 0

    def _vector(self, code: int) -> np.ndarray:
        return np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1

    def _slot(self, code: int) -> int:
        if code not in self.slot_of:
            self.slot_of[code] = len(self.letters)
            self.letters.append(self._vector(code))
        return self.slot_of[code]

    def slots(self, text: str) -> np.ndarray:
        """A slot for each character; 0 for what isn't a letter."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.ascii[np.minimum(code, 127)]
        high = np.flatnonzero(code > 127)
        if len(high):
            kinds, back = np.unique(code[high], return_inverse=True)
            for c in kinds.tolist():
                if c not in self.wide:
                    ch = chr(c).lower()[0]
                    self.wide[c] = self._slot(ord(ch)) if ch.isalpha() else 0
            out[high] = np.array([self.wide[c] for c in kinds.tolist()], np.int32)[back]
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """n-grams of the text, by this worker's numbers, and their counts; None without a letter.  Runs of
        non-letters are one gap."""
        kinds, sums, rest, any_letter = [], [], np.zeros(1, np.int32), False
        for i in range(0, len(text), _CHUNK):
            s = np.concatenate((rest, self.slots(text[i : i + _CHUNK])))
            any_letter |= bool(s.any())
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
            s = s[keep]
            last = i + _CHUNK >= len(text)
            if last and s[-1]:
                s = np.append(s, np.int32(0))
            if len(s) >= GRAM:
                k, n = np.unique(self._codes(s), return_counts=True)
                kinds.append(k)
                sums.append(n)
            rest = s[-(GRAM - 1) :]
        if not any_letter:
            return None
        return (kinds[0], sums[0]) if len(kinds) == 1 else merged(kinds, sums)

    def _codes(self, s: np.ndarray) -> np.ndarray:
        a, b, c = s[:-2], s[1:-1], s[2:]
        near = (a * SLOTS + b) * SLOTS + c
        if s.max() < SLOTS:
            return near
        a, b, c = (x.astype(np.int64) for x in (a, b, c))
        return np.where(np.maximum(np.maximum(a, b), c) < SLOTS, near, _WIDE | a << 40 | b << 20 | c)

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        """Places in ``bound`` of at most _SLICE n-grams, binding those not met before."""
        wide = np.flatnonzero(grams >= SLOTS**GRAM)
        places = self.at[np.where(grams < SLOTS**GRAM, grams, 0)] if len(wide) else self.at[grams]
        if len(wide):
            places[wide] = [self.far.get(g, -1) for g in grams[wide].tolist()]
        new = np.flatnonzero(places < 0)
        if not len(new):
            return places
        if self.used + len(new) > _ROWS:
            self._clear()
            return self._rows(grams)
        g = grams[new].astype(np.int64)
        far = g >= _WIDE
        parts = [np.where(far, (g >> k) & 0xFFFFF, g // SLOTS**i % SLOTS) for i, k in ((2, 40), (1, 20), (0, 0))]
        vectors = np.ones((len(new), self.dim), np.int8)
        for i, slots in enumerate(parts):
            kinds, back = np.unique(slots, return_inverse=True)
            turned = np.roll(np.array([self.letters[k] for k in kinds.tolist()]), GRAM - 1 - i, axis=1)
            vectors *= turned[back]
        own = np.arange(self.used, self.used + len(new), dtype=np.int32)
        self.bound[own[0] : own[-1] + 1] = vectors
        self.at[g[~far]] = own[~far]
        self.far.update(zip(g[far].tolist(), own[far].tolist(), strict=True))
        self.used += len(new)
        places[new] = own
        return places

    def bundle(self, counted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The sum of the n-grams' vectors, in whole numbers."""
        grams, n = counted
        kind, total = np.float32 if int(n.sum()) < _EXACT else np.float64, np.zeros(self.dim)
        for i in range(0, len(grams), _SLICE):
            total += n[i : i + _SLICE].astype(kind) @ self.bound[self._rows(grams[i : i + _SLICE])].astype(kind)
        return total


def merged(kinds: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(np.concatenate(kinds), return_inverse=True)
    return k, np.rint(np.bincount(back, np.concatenate(sums))).astype(np.int64)


class _Sum:
    """One language's bundle in a partition: counts wait until they are many."""

    def __init__(self, dim: int):
        self.vector, self.kinds, self.sums, self.waiting = np.zeros(dim, np.int64), [], [], 0

    def add(self, own: Space, counted: tuple[np.ndarray, np.ndarray]) -> None:
        self.kinds.append(counted[0])
        self.sums.append(counted[1])
        self.waiting += len(counted[0])
        if self.waiting > 1 << 18:
            self.settle(own)

    def settle(self, own: Space) -> np.ndarray:
        if self.kinds:
            self.vector += np.rint(own.bundle(merged(self.kinds, self.sums))).astype(np.int64)
            self.kinds, self.sums, self.waiting = [], [], 0
        return self.vector


def space(dim: int, seed: int) -> Space:
    return resident(("space", dim, seed), lambda: Space(dim, seed))


def fit(labelled: DataFrame, dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes of all rows (text, lang), over the whole table.

    Each partition gives one vector of whole numbers for each language, and those are added up, so prototypes
    don't hang on the partitions; the driver gets one vector of ``dim`` numbers for each language.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, sums = space(dim, seed), {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if counted := s.counts(text):
                    if lang not in sums:
                        sums[lang] = _Sum(dim)
                    sums[lang].add(s, counted)
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(own.settle(s))], ["lang", "i", "v"])
        give_back()

    rows = labelled.select("text", "lang").where("text is not null and lang is not null").mapInArrow(part, "lang string, i int, v long")
    got = rows.groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).collect()
    return {r["lang"]: np.array([x["v"] for x in r["v"]], np.float64) for r in sorted(got, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, seed: int = SEED, keep_text: bool = False, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of ``docs``, its text only on demand, and those of ``into``: the language and its cosine (0
    where that is negative)."""
    names = sorted(prototypes)
    unit = np.array([prototypes[k] / max(np.linalg.norm(prototypes[k]), 1e-9) for k in names], np.float64).reshape(len(names), dim)
    kept = [f for f in docs.schema if keep_text or f.name != "text"]
    schema = StructType([*kept, StructField(into[0], StringType()), StructField(into[1], DoubleType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space(dim, seed)
        for b in batches:
            langs, scores = [], []
            for text in b.column("text").to_pylist():
                counted = s.counts(text) if text else None
                if counted is None or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                v = s.bundle(counted)
                cos = unit @ v / max(float(np.linalg.norm(v)), 1e-9)
                best = int(np.argmax(cos))
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cos[best]))))
            own = [c for c, name in zip(b.columns, b.schema.names, strict=True) if keep_text or name != "text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)
        give_back()

    return docs.mapInArrow(part, schema)


def held_out(doc_id):
    """Rows never learnt from: crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
