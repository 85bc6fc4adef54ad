"""Token alignment against a plain walk over whole encodings."""

import hashlib
import re
from collections import Counter

import pytest

from corpusweave.llm import align
from corpusweave.llm.queries import op11_cross_tokenizer, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TRAPS = [
    "plain words, twice plain words", "  two  blanks  ", " ", "tab\tand\nline \n x", "a <|endoftext|> b <s> c <0x0A> d", "▁ mark", "mark▁", "no break  wide 　 x",
    "ﬁligature ́ accents é", "日本語の 文章 です", "😀😀 😀", "\x00zero \x1c x", "it's we'll I'd  don't", "a" * 3000 + " " + "ab" * 500, "", None, "x ​z y", "12 345 6,7", "...  \u0085 y",
]


@pytest.fixture(scope="module")
def pair():
    return align.Pair(A, B)


def tokens(pair, text):
    """(id, start, end) of both sides by encoding the whole text, or nothing."""
    if not text:
        return [], []
    raw, out = (" " + text).encode(), []
    for ids, spelt in ((pair.a.encode(" " + text, add_special_tokens=False).ids, pair.bytes_a), (pair.b.encode(text), pair.bytes_b)):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(spelt[i])))
            at += len(spelt[i])
        if b"".join(spelt[i] for i in ids) != raw:
            return [], []
        out.append(side)
    return out


def brute(pair, texts):
    rows, counts = [], Counter()
    for text in texts:
        a, b = tokens(pair, text)
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        ids_a, ids_b = ({e: i for i, _, e in side} for side in (a, b))  # tokens have bytes, so no two of a side end together
        links = [(ids_a[e], ids_b[e]) for e in both]
        counts.update(links)
        parts, left = [], [list(reversed(a)), list(reversed(b))]
        for e in both:
            taken = [[], []]
            for side in (0, 1):
                while left[side] and left[side][-1][2] <= e:
                    taken[side].append(str(left[side].pop()[0]))
            parts.append("|".join(map(",".join, taken)))
        rows.append((len(a), len(b), len(both), links, ";".join(parts)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, g, len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(s.encode()).hexdigest() if s else "") for n_a, n_b, g, x, s in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_traps_by_brute_force(spark, pair):
    df = spark.createDataFrame(list(enumerate(TRAPS)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.with_pair_counts(align.aligned(df, A, B, digest=True)).collect()}
    want = brute(pair, TRAPS)
    assert {i: got[i] for i in range(len(TRAPS))} == dict(enumerate(want))
    assert sum(w[0] > 0 for w in want) > 12 and want[5] == want[14] == (0, 0, 0, 0, 0, 0, "")


def test_query_by_brute_force(spark, sf_dir, pair, docs):
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op11_cross_tokenizer(spark, sf_dir).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], brute(pair, [r["text"] for r in rows]), strict=True))


def test_segments_encode_as_the_whole(pair):
    for text in filter(None, TRAPS):
        parts = pair.segments(text)
        assert sum((pair.a.encode(" " + p, add_special_tokens=False).ids for p in parts), []) == pair.a.encode(" " + text, add_special_tokens=False).ids
        assert sum((pair.b.encode(p) for p in parts), []) == pair.b.encode(text)
    assert pair.cuts and len(pair.segments(TRAPS[0])) == 5


def test_every_character_cuts_alike(pair):
    """Around a space, each character of the basic plane: segments and whole texts give the same tokens."""
    for low in range(32, 0x10000, 512):
        chars = [chr(c) for c in range(low, min(low + 512, 0x10000)) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"x{c} {c}y" for c in chars)
        parts = pair.segments(text)
        assert [i for p in parts for i in pair.a.encode(" " + p, add_special_tokens=False).ids] == pair.a.encode(" " + text, add_special_tokens=False).ids, low
        assert [i for p in parts for i in pair.b.encode(p)] == pair.b.encode(text), low


def test_overlaps_by_brute_force(spark, pair):
    df = spark.createDataFrame([*enumerate(TRAPS[:11]), (3, TRAPS[3])], "doc_id long, text string")
    want = Counter()
    for i, text in [*enumerate(TRAPS[:11]), (3, TRAPS[3])]:
        a, b = tokens(pair, text)
        want.update((i, p, q, x, y, max(s, t), min(e, f), e == f) for p, (x, s, e) in enumerate(a) for q, (y, t, f) in enumerate(b) if s < f and t < e)
    assert Counter(tuple(r) for r in align.overlaps(df, A, B).collect()) == want


def test_pairs_stay_within_the_vocabularies_bound(spark, pair, docs):
    rows = align.aligned(docs, A, B)
    assert 0 < align.pair_counts(rows).count() < pair.most_pairs() < 2_000_000
    groups = rows.where("n_groups > 2").first()["groups"]
    assert re.fullmatch(r"\d+(,\d+)*\|\d+(,\d+)*(;\d+(,\d+)*\|\d+(,\d+)*)*", groups)


def test_odd_rows_and_empty_table(spark, odd, none):
    got = align.with_pair_counts(align.aligned(odd, A, B, digest=True)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    assert {r["doc_id"]: (r["n_a"], r["groups_sha256"]) for r in got}[1] == (0, "")
    assert align.with_pair_counts(align.aligned(none, A, B)).count() == align.overlaps(none, A, B).count() == 0
