"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, and a shunting-yard
parser evaluates and/or/with licence expressions after ``SPDX-License-Identifier``.

Words are runs of ASCII letters and digits and of all characters above ASCII; A-Z is lower-cased.
A phrase matches where its words stand consecutively, so punctuation and line ends between them don't matter.

Defined results: null and empty texts have no words, places or labels and score 0; repeated rows give
equal results; a malformed expression keeps the labels of the identifiers that it names; texts of any
length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# The base phrases of the contract, further notice phrases, and SPDX identifiers with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit": "mit",
    "licensed under the apache": "apache",
    "gnu gpl": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons zero": "cc0",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by": "cc-by",
    "all rights reserved": "proprietary",
    "released into the public domain": "public-domain",
}
TAG = "spdx license identifier"
FAMILIES = (
    ("mit", "mit"), ("apache-", "apache"), ("gpl-", "gpl"), ("lgpl-", "lgpl"), ("agpl-", "agpl"), ("mpl-", "mpl"), ("epl-", "epl"),
    ("bsd-", "bsd"), ("0bsd", "bsd"), ("isc", "isc"), ("bsl-", "bsl"), ("cc0-", "cc0"), ("cc-by-nc-sa", "cc-by-nc-sa"), ("cc-by-nc-nd", "cc-by-nc-nd"),
    ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by-nd", "cc-by-nd"), ("cc-by", "cc-by"), ("unlicense", "public-domain"), ("zlib", "zlib"),
)
PERMISSIVE = frozenset("mit apache bsd isc bsl cc0 cc-by public-domain zlib".split())
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_EXPRESSION = re.compile(rb"spdx-license-identifier[\x20\t]*:[\x20\t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[a-z0-9.+:-]+", re.I)


def label_of(identifier: str) -> str | None:
    low = identifier.lower()
    return next((label for start, label in FAMILIES if low == start or start.endswith("-") and low.startswith(start) or low.startswith(f"{start}-")), None)


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order, by the shunting-yard algorithm; None where it is malformed."""
    out, ops, operand = [], [], True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in PRECEDENCE:
            if operand:
                return None
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif token == "(":
            if not operand:
                return None
            ops.append(token)
        elif token == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        else:
            if not operand:
                break  # what follows a whole expression is prose, such as a comment's end
            out.append(token)
            operand = False
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(expression: str) -> tuple[set[str], bool]:
    """Labels that the expression names, and whether some choice of it is permissive.

    ``a or b`` leaves the choice, ``a and b`` binds both, ``a with b`` is ``a`` with an exception."""
    order = postfix(expression)
    if order is None:
        names = {x for t in _TOKEN.findall(expression) if (x := label_of(t))}
        return names, False
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a if token == "with" else (a[0] | b[0], (a[1] or b[1]) if token == "or" else (a[1] and b[1])))
        else:
            label = label_of(token)
            stack.append(({label} if label else set(), label in PERMISSIVE))
    return stack[0]


@cache
def automaton():
    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def scan(text: str | None) -> tuple[int, list[tuple[int, str, str]], set[str], bool | None]:
    """Number of words; places (first word, phrase, label); labels of expressions; whether these are permissive."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_KEEP).split()
    if not words:
        return 0, [], set(), None
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # one character for each byte; phrases are ASCII
    places, named, free, word, seen = [], set(), None, 0, 0
    hits = sorted((end - len(phrase) - 1, phrase, label) for end, (phrase, label) in automaton().iter(line))
    for start, phrase, label in hits:
        word += line.count(" ", seen, start)
        seen = start
        if label:
            places.append((word, phrase, label))
    if any(phrase == TAG for _, phrase, _ in hits):
        for m in _EXPRESSION.finditer(raw):
            labels, ok = evaluate(m[1].decode("utf-8", "replace"))
            named |= labels
            free = ok if free is None else free and ok
    return len(words), places, named, free


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, places array<struct<word: bigint, phrase: string, label: string>>"
_PLACE = pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string())])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and SCHEMA for every row of ``docs`` (doc_id, text).  score: 1 where a base phrase or an
    evaluated expression stands, 0.7 where only another notice does."""

    def row(text: str | None) -> tuple:
        n, places, named, free = scan(text)
        base = [(w, label) for w, phrase, label in places if phrase in BASE]
        sure = sorted({label for _, label in base})
        labels = sorted({label for _, _, label in places} | named)
        score = 1.0 if base or named else 0.7 if labels else 0.0
        at = [w for w, _ in base]
        return n, len(base), min(at, default=None), max(at, default=None), ",".join(sure), ",".join(labels), score, free, [{"word": w, "phrase": p, "label": x} for w, p, x in places]

    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_(), pa.list_(_PLACE)]
    names = [x.split()[0] for x in re.sub(r"<.*>", "", SCHEMA).split(", ")]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {kind}, {SCHEMA}")
