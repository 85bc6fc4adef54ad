"""Joins by cells, segments, n-grams and diagonals against all pairs."""

import itertools
import random
import re
from collections import Counter

import pytest

from corpusweave.operators import scaled_joins as J
from corpusweave.sources.tables import read


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def planned(df):
    return df._jdf.queryExecution().toString()


def no_nested_loop(df):
    assert "NestedLoop" not in planned(df) and "Cartesian" not in planned(df)


def test_intervals_by_all_pairs(spark):
    rng = random.Random(3)
    points = [(i, rng.choice("ab"), rng.choice(["k", "l", None]), rng.randrange(-50, 3000)) for i in range(300)]
    windows = [(i, rng.choice("ab"), rng.choice(["k", "l", None]), low := rng.randrange(-60, 3000), low + rng.choice([0, 0, 1, 5, 64, 900, -3, 2800])) for i in range(250)]
    windows += [(999, "a", None, None, 5), (998, None, None, 0, 3000), (997, "a", "k", 10, None)]
    p = spark.createDataFrame(points, "i long, api string, who string, at long")
    w = spark.createDataFrame(windows, "j long, api string, who string, low long, high long")
    got = J.interval_join(p, w, "at", "low", "high", keys=("api",), optional=("who",))
    want = Counter((i, j) for (i, a, k, t), (j, b, m, lo, hi) in itertools.product(points, windows) if a == b and (m is None or m == k) and lo is not None and hi is not None and lo <= t <= hi)
    assert Counter((r["i"], r["j"]) for r in got.collect()) == want and len(want) > 1000
    no_nested_loop(got)
    assert J.interval_join(p, w.limit(0), "at", "low", "high").count() == J.interval_join(p.limit(0), w, "at", "low", "high").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_usage_by_all_pairs(spark, seed):
    rng = random.Random(seed)
    points = [(rng.choice("ab"), rng.choice(["k", "l", None]), rng.choice([None, *range(-50, 900)]), rng.choice([None, 0.25, 7.5, 1e18 * (rng.random() < 0.01)])) for _ in range(800)]
    windows = [(i, rng.choice(["a", "b", None]), rng.choice(["k", "l", None]), low := rng.randrange(-60, 900), low + rng.choice([0, 1, 2, 3, 4, 14, 15, 16, 63, 64, 255, 300, 900, -3])) for i in range(400)]
    p = spark.createDataFrame(points, "api string, who string, at long, value double")
    w = spark.createDataFrame(windows, "j long, api string, who string, low long, high long")
    used = J.interval_usage(p, w, "j", "at", "low", "high", "value", keys=("api",), optional=("who",))
    want = {}
    for j, b, m, lo, hi in windows:
        if got := [v for a, k, t, v in points if t is not None and a == b and m in (None, k) and lo <= t <= hi]:
            want[j] = len(got), sum(x or 0 for x in got) if any(x is not None for x in got) else None
    got = {r["j"]: (r["calls"], r["total"]) for r in used.collect()}
    assert got.keys() == want.keys() and len(want) > 150
    assert all(got[j] == (n, v if v is None else pytest.approx(v, rel=1e-12)) for j, (n, v) in want.items())
    assert "Join" not in planned(used)
    assert "BroadcastHashJoin" not in planned(J.interval_join(p, w, "at", "low", "high", keys=("api",), optional=("who",)))


def test_windows_as_many_as_the_log(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("event_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS at")
    w = e.selectExpr("event_id AS j", "at AS low", "at + 3600000000 AS high")
    got = J.interval_join(e, w, "at", "low", "high")
    no_nested_loop(got)
    at = [r["at"] for r in e.collect()]
    assert got.count() == sum(a <= b <= a + 3_600_000_000 for a in at for b in at)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_near_strings_by_all_pairs(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(0, 9))) for _ in range(150)} | {"", "a", "bolt", "colt", "bol", "blot", "😀b", "😀"}
    df = spark.createDataFrame([(w,) for w in [*words, "bolt", None]], "w string")
    got = J.near_strings(df, df, "w", "w", most)
    assert {(r["a"], r["b"], r["d"]) for r in got.collect()} == {(a, b, lev(a, b)) for a in words for b in words if lev(a, b) <= most}
    assert got.count() == got.distinct().count()
    no_nested_loop(got)


TERMS = ["ring", "red ring", "red  ring", "Red", "k-means", "-x", "x-", "...", "two\twords here", "éa", "", None, " ~ ", "_a", "a"]
TEXTS = [
    "A red ring, RED~RING and red\n ring; ringing red", "k-means k -means k- means K-MEANS", "a -x y-x x- x-y", "wait... for....", "two words  here twowords here", "éa Éa aéa a", "", None, "_a a_a a",
    "red ring" * 3, "  ring",
]


def term_hits(text, term):
    """Places of the term as the pattern (?<!word)term(?!word) with seams, ASCII words and case."""
    words = [re.escape(w) for w in re.split(r"[~\s]+", term or "", flags=re.A) if w]
    if not words or not text:
        return 0
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    return len(re.findall(f"(?=(?<![A-Za-z0-9_]){fold(r'[~\s]+'.join(words))}(?![A-Za-z0-9_]))", fold(text), re.A))


def test_terms_by_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    places = J.term_places(docs, terms, "doc_id", "text", "term")
    no_nested_loop(places)
    got = Counter((r["doc_id"], r["term"]) for r in places.collect())
    for i, text in enumerate(TEXTS):
        for t in TERMS:
            assert got[i, t] == term_hits(text, t), (text, t)
    assert sum(got.values()) > 30 and not any(t in ("", " ~ ", None) for _, t in got)


def test_only_grams_that_may_be_terms_leave_the_texts(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(900)}" for _ in range(400))) for i in range(50)], "key long, text string")
    terms = [f"w{i} w{i + 1} w{i + 2}" for i in range(0, 60, 3)] + ["w7", "w8 w9"]
    known = spark.createDataFrame([(len(t.split()), t, t.split()[0]) for t in terms], "n int, gram string, head string")
    got = J.term_candidates(docs, known, [1, 2, 3])
    n = sum(term_hits(r["text"], t) for r in docs.collect() for t in terms)
    assert n <= got.count() <= n + 5 and n > 10  # of 60,000 grams
    assert "transform(" not in planned(J.term_places(docs, known, "key", "text", "gram"))


def test_longest_places(spark):
    docs = spark.createDataFrame([(1, "red ring red"), (2, "ring"), (3, "a red ring of x")], "doc_id long, text string")
    terms = spark.createDataFrame([("red",), ("ring",), ("red ring",), ("Red Ring",), ("ring of",)], "term string")
    got = J.longest_places(J.term_places(docs, terms, "doc_id", "text", "term"), "doc_id")
    assert {(r["doc_id"], r["pos"], r["term"]) for r in got.collect()} == {(1, 0, "Red Ring"), (1, 2, "red"), (2, 0, "ring"), (3, 1, "Red Ring"), (3, 2, "ring of")}


def test_anchors_by_diagonals(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    words = lambda t: [w for w in re.split(r"[^a-z0-9\x80-\U0010FFFF]+", (t or "").lower()) if w]
    d = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    want = {}
    for item in items.collect():
        w = words(item["text"])
        grams = {}
        for i in range(len(w) - 5):
            grams.setdefault(tuple(w[i : i + 6]), []).append(i)
        for doc_id, v in d.items():
            lines = {}
            for j in range(len(v) - 5):
                for i in grams.get(tuple(v[j : j + 6]), []):
                    lines.setdefault(j - i, set()).add(i)
            if lines:
                scored = max((len({k for i in at for k in range(i, i + 6)}), -off, len(at)) for off, at in lines.items())
                want[doc_id, item["item_id"]] = (-scored[1], scored[2], scored[0], len(w))
    got = J.gram_anchors(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["offset"], r["votes"], r["covered"], r["n_words"]) for r in got.collect()} == want and want
    no_nested_loop(got)
