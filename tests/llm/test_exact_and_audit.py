"""Exact copies and the filter audit against plain loops."""

import hashlib
import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusweave.llm import exact_dedup, filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows):
    """{position: (keep_id, size, kept, sha)} of (id, text) rows, ties by position."""
    groups = {}
    for at, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, at))
    return {at: (rows[min(g)[3]][0], len(g), min(g)[3] == at, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for *_, at in g}


def seen(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_copies_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain(rows)
    assert seen(exact_dedup.copies(odd.coalesce(1))) == Counter((rows[at][0], *v) for at, v in want.items())
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns and left.count() == sum(v[2] for v in want.values())
    assert {r["doc_id"] for r in left.collect()} == {rows[at][0] for at, v in want.items() if v[2]}


def test_white_space_and_length_decide(spark):
    rows = [(5, "ab"), (4, "a b"), (3, "a\tb"), (2, "a b"), (9, " \n"), (8, None), (7, ""), (1, "a\x1cb"), (None, "a  b c"), (None, "ab c"), (6, "a b  c"), (11, "É é"), (12, "Éé")]
    got = exact_dedup.copies(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert seen(got) == Counter((rows[at][0], *v) for at, v in plain(rows).items())
    by_id = {r["doc_id"]: r for r in got.collect() if r["doc_id"]}
    assert by_id[5]["keep_id"] == 3 and by_id[8]["keep_id"] == 9 and by_id[12]["keep_id"] == 11 and by_id[2]["group_size"] == by_id[1]["group_size"] == 1


def test_weak_hash_costs_no_result(spark, docs):
    """With a hash of four values nearly all texts collide; bytes tell them apart."""
    weak = lambda body: F.unhex(F.rpad(F.substring(F.md5(body), 1, 1), 32, "0"))
    some = docs.where("length(text) < 4000")
    assert seen(exact_dedup.copies(some, digest=weak)) == seen(exact_dedup.copies(some))


def test_no_copies_and_no_rows(spark, none):
    assert exact_dedup.copies(none).count() == exact_dedup.drop_copies(none).count() == 0
    got = exact_dedup.copies(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert all(r["kept"] and r["group_size"] == 1 and r["keep_id"] == r["doc_id"] for r in got)


def walk(rows, labels):
    """The audit by walking each document through each order."""
    fails, out = [], Counter()
    texts = {}
    for i, t, s in rows:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > texts[t]}
        fails.append((s or "", {k for k, v in own.items() if v}, labels.get(i, (0, 0))))
    for order in itertools.permutations("ABCDE"):
        for part, bad, (good, toxic) in fails:
            gone = next((n for n, x in enumerate(order, 1) if x in bad), 6)
            for n, x in enumerate(order, 1):
                key = (part, "".join(order), n)
                for name, on in (("kept", gone > n), ("removed", gone == n), ("redundant", gone < n and x in bad), ("unique_fails", bad == {x}), ("good_lost", gone == n and good == 1), ("toxic_lost", gone == n and toxic == 1)):
                    out[key, name] += on
                out[(part, x), "shapley"] += gone == n
    return out


def audited(df, labels):
    out = Counter()
    for r in filter_audit.audit(df, labels).collect():
        key = (r["part"], r["filter_order"], r["step"])
        out.update({(key, c): r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")})
        out[(r["part"], r["filter_order"][r["step"] - 1]), "shapley"] = r["shapley"]
    return out


def test_audit_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 1), (4, 1, 0), (None, 1, 1), (8, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = audited(odd, labels)
    want = walk([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], {5: (1, 1), 4: (1, 0), 8: (0, 1)})
    assert got == want and {k[0] for k, c in got if c == "kept"} == {"", "s", "t", "u"}


def test_audit_of_the_table(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = walk([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()})
    assert audited(docs, labels) == want


def test_audit_of_nothing_and_totals(spark, none, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    flags = filter_audit.with_labels(filter_audit.with_copies(filter_audit.failures(docs)), labels)
    whole = {r["mask"]: r["kept"] for r in filter_audit.survivors(flags, of_parts=False).collect()}
    parts = Counter()
    for r in filter_audit.survivors(flags).collect():
        parts[r["mask"]] += r["kept"]
    assert whole == dict(parts) and len(whole) == 32 and whole[0] == docs.count()
