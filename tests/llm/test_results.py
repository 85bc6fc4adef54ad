"""Operators against brute force on a small table."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusweave.llm import decontaminate, html_extract, langid, licenses, mixing, near_dedup, pii, queries, spotsigs, token_blocks
from corpusweave.llm.html_extract import main_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_mixing_meets_targets(spark, sf_dir):
    got = collected(mixing.mix_amounts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    sources = sorted({r["source"] for r in got})
    size = {s: sum(r["size"] for r in got if r["source"] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, left = {}, set(sources)
    while left:
        level = (1.5 * sum(size.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level >= 2 * size[s]}
        target |= {s: 2 * size[s] for s in over} if over else {s: weight[s] * level for s in left}
        left = left - over if over else set()
    for s in sources:
        rows = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 2 * r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target[s]) <= 0.5


def test_mixed_corpus_has_the_words_it_says(spark, docs):
    want = sum(r["taken"] for r in collected(mixing.mix_amounts(docs)))
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixing.mix(docs).collect()) == want


def chains(text):
    """The signatures by a plain search from each anchor."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for i, w in enumerate(words):
        content = [x for x in words[i + 1 :] if x not in spotsigs.COMMON][:2]
        if w in spotsigs.ANCHORS and len(content) == 2:
            out.add((w, *content))
    return out or ({(" ".join(words) or text,)} if text else set())


def test_edited_fingerprints(spark, docs, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in collected(spotsigs.edited_likeness(docs))}
    for i, (doc_id, text) in enumerate(rows):
        after, k = rows[(i + 1) % len(rows)][1], len(text) // 4
        new = text[: len(text) - k] + after[:k]
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert got[doc_id]["edited_fingerprint"] == spotsigs.fingerprint(new)
        assert got[doc_id]["fingerprint"] == spotsigs.fingerprint(text)
        for name, other in (("near_edited", new), ("near_next", after)):
            a, b = chains(text), chains(other)
            want = 1.0 if not a | b else len(a & b) / len(a | b)
            assert abs(got[doc_id][name] - want) < 1e-9


def test_pruned_jaccard_is_the_plain_one_above_its_threshold():
    rng = np.random.default_rng(1)
    for _ in range(500):
        a, b = (sorted({f"{x:010x}" for x in rng.integers(0, 300, rng.integers(1, 400))}) for _ in range(2))
        want = len({*a} & {*b}) / len({*a} | {*b})
        for least in (0.0, 0.05, 0.3, 0.8):
            assert abs(spotsigs.jaccard(a, b, least) - (want if want >= least else 0.0)) < 1e-12


def test_near_pairs_lose_no_pair(spark, docs):
    marks = sorted({spotsigs.fingerprint(r["text"]) for r in docs.collect()} - {""})
    sets = [spotsigs.split(m) for m in marks]
    want = {(marks[i], marks[j]) for i in range(len(marks)) for j in range(i + 1, len(marks)) if len({*sets[i]} & {*sets[j]}) >= 0.5 * len({*sets[i]} | {*sets[j]})}
    assert {(r["mark_a"], r["mark_b"]) for r in collected(spotsigs.near_pairs(docs, 0.5))} == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, hit):
    d = re.sub(r"[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_base_spans(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts |= {90001: "a@b.c_d@e.f x@y.zz.", 90002: "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", 90003: "4111 1111 1111 1111, 4111-1111-1111-1112", 90004: "+1 (555) 010-9999 ++49 30 1234567 +12", 90005: "é😀 a@b.co 😀 1.1.1.1"}
    texts[90006] = "1 2 " * 60_000
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in collected(pii.detect(df)):
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, texts[r["doc_id"]]) if valid(k, m.group())]
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == want


def test_clean_documents_get_no_span(spark):
    df = spark.createDataFrame([(1, "Version 1.2.3 of order 1234-5678, pages 12-14."), (2, "mail me"), (3, "call 555")], "doc_id long, text string")
    assert all(r["spans"] == [] for r in collected(pii.detect(df)))


def test_components(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = "the quick brown fox jumps over a lazy dog while seven wizards watch from afar and cheer loudly for it".split()
    star = [(70000 + i, " ".join([*base[:i], f"w{i}", *base[i + 1 :]])) for i in range(len(base))]
    rows += star + [(80000, " ".join(base)), (80001, "  ".join(base).upper())]
    sets = {i: near_dedup.shingle_set(t, 2) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in collected(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2))}
    assert {i: got[i]["component_id"] for i in ids} == {i: find(i) for i in ids}
    assert {i: got[i]["n_shingles"] for i in ids} == {i: len(sets[i]) for i in ids}


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_dense_regions_reach_the_same_classes(spark, docs, monkeypatch, levels):
    base = "the quick brown fox jumps over a lazy dog while seven wizards watch from afar and cheer loudly for it".split()
    odd = [(70000 + i, " ".join([*base[: i % 19], f"w{i}", f"v{i}", *base[i % 19 :]])) for i in range(60)]  # one region, several classes
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want = {r["doc_id"]: r["component_id"] for r in collected(near_dedup.near_duplicates(docs, 2))}
    deeper = []
    branches = near_dedup._branches
    monkeypatch.setattr(near_dedup, "_branches", lambda *a: deeper.append(a[2]) or branches(*a))
    monkeypatch.setattr(near_dedup, "KEPT", 0)  # no candidate of the first round, so that the second has all to do
    monkeypatch.setattr(near_dedup, "DENSE", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 1)
    monkeypatch.setattr(near_dedup, "LEVELS", levels)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    assert {r["doc_id"]: r["component_id"] for r in collected(near_dedup.near_duplicates(docs, 2))} == want
    assert bool(deeper) == bool(levels)


@pytest.mark.parametrize("margin", [near_dedup.MARGIN, None])
def test_regions_of_over_512_against_all_pairs(spark, monkeypatch, margin):
    """1,300 edits of one text: regions dense at the real limit, many classes, and pairs on both sides of 0.8."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(1300):
        words = list(base)
        for at in rng.choice(160, 4 + i % 7, replace=False):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    code: dict = {}
    has = np.zeros((len(rows), 30000), np.float32)
    for i, t in rows:
        has[i, [code.setdefault(x, len(code)) for x in near_dedup.shingle_set(t, 2)]] = 1
    size = has.sum(axis=1)
    both = has @ has.T
    links = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    top = np.arange(len(rows))
    while True:
        low = np.where(links, top[None, :], len(rows)).min(axis=1)
        if (low == top).all():
            break
        top = low
    merged, before = [], near_dedup._merged
    monkeypatch.setattr(near_dedup, "_merged", lambda tight: merged.append(before(tight)) or merged[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in collected(near_dedup.near_duplicates(docs, 2, margin=margin))}
    assert got == dict(enumerate(top.tolist()))
    assert 50 < len(set(got.values())) < 1250
    # a node stands in few merged regions, though it is dense in up to 26 trees
    per = merged[0].groupBy("node").count()
    assert merged[0].count() > near_dedup.DENSE and per.agg({"count": "avg"}).first()[0] < 2


def test_sets_that_share_a_name_are_parted(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "names_of", lambda h: (7, int(h[0] >> np.uint64(1))) if len(h) else (None, None))
    rows = [(i, t) for i, t in enumerate(["a b c d", "e f g h", "a b  c d", "", "i j"])]
    got = {r["doc_id"]: r["component_id"] for r in collected(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2))}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    rows = [*((r["doc_id"], r["text"]) for r in docs.collect()), (99990, "it's <|endoftext|>x <|ENDOFTEXT|> É, naïve!!! don't 日本"), (99991, None)]
    got = {r["doc_id"]: r for r in collected(token_blocks.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path()))}
    for doc_id, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 200_000])
def test_blocks_round_trip_and_notice_damage(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49000).astype(np.uint32)
    kinds, counts = np.unique(ids, return_counts=True)
    table = token_blocks.Table(*token_blocks.frequencies(dict(zip(kinds.tolist(), counts.tolist(), strict=True))))
    lengths = np.array([n // 3, n - n // 3])
    block = table.encode(ids, lengths)
    found, back = table.decode(block)
    assert (back == ids).all() and found.tolist() == lengths.tolist()
    if n > 1024:
        entropy = -(counts / n * np.log2(counts / n)).sum() * n / 8
        assert n < 100_000 or len(block) < 1.2 * entropy
        with pytest.raises((ValueError, IndexError)):
            table.decode(block[:-2000] + bytes(len(block[-2000:])))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learnt = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    got = collected(langid.predict(docs.where(langid.held_out(docs["doc_id"])).select("doc_id", "lang", "text"), learnt))
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(langid.held_out_id(r["doc_id"]) for r in got)


def test_bundles_are_sums_over_chunks(monkeypatch):
    s = langid.Space(64)
    text = "Über the höhe, 12 of it " * 50
    whole = s.bundle(s.counts(text))
    monkeypatch.setattr(langid, "_CHUNK", 7)
    assert np.allclose(whole, s.bundle(s.counts(text)))


def test_license_places(spark, docs):
    phrases = {k: k.split() for k in licenses.BASE}
    for r in docs.collect():
        w = words(r["text"])
        want = [(i, p) for i in range(len(w)) for p, x in phrases.items() if w[i : i + len(x)] == x]
        n, places, _, _ = licenses.scan(r["text"])
        assert n == len(w) and sorted((a, p) for a, p, _ in places if p in phrases) == want


def test_license_expressions():
    assert licenses.evaluate("MIT OR Apache-2.0") == ({"mit", "apache"}, True)
    assert licenses.evaluate("MIT AND GPL-3.0-only") == ({"mit", "gpl"}, False)
    assert licenses.evaluate("(MIT OR GPL-2.0) AND BSD-3-Clause") == ({"mit", "gpl", "bsd"}, True)
    assert licenses.evaluate("GPL-2.0-only WITH Classpath-exception-2.0") == ({"gpl"}, False)
    assert licenses.evaluate("MIT AND AND") == ({"mit"}, False)
    assert licenses.scan("// SPDX-License-Identifier: Apache-2.0 */\nx")[2] == {"apache"}


def test_contamination(spark, docs, sf_dir):
    items = [*((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), (5000, "Of, the"), (5001, "")]
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for at in range(len(w) - size + 1) if w else ():
            wins[tuple(w[at : at + size])].add(item)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.BLOCK, 3):
        got = {r["doc_id"]: r for r in collected(decontaminate.contamination(docs, bench, limit))}
        for r in docs.collect():
            w, hit, found = words(r["text"]), set(), set()
            for size in {len(k) for k in wins}:
                for at in range(len(w) - size + 1):
                    if k := wins.get(tuple(w[at : at + size])):
                        hit |= set(range(at, at + size))
                        found |= k
            row = got[r["doc_id"]]
            assert (row["n_words"], row["n_hit"], set(row["item_ids"])) == (len(w), len(hit), found)


ARTICLE = """<html><head><title>T</title></head><body><header><p>Our site has a long line about everything here</p></header><nav><a href=x>a</a></nav>
<div class="cookie-notice"><p>We use cookies and we like to tell you so at great length in this notice.</p></div><article><h1>Big &amp; title</h1><p>One <b>two</b>three<br>four.<p>Open
 paragraph &nbsp; here<script>var x="</p>"</script>.</p><aside>see also</aside><form>name <button>ok</button></form><section id="comments"><p>I like this very much indeed.</p></section></article><footer>&copy; foo</footer></body></html>"""


def test_main_text():
    assert main_text(ARTICLE) == "Big & title One twothree four. Open paragraph here."
    assert main_text(None) == main_text("") == main_text("<nav><a>x</a></nav>") == ""


def test_tree_of_the_labelled_blocks():
    """The tree separates the labelled blocks; without the hint of the markup, words and links tell most of them."""
    right = lambda tree: np.mean([html_extract.keeps(tree, r[:-1]) == bool(r[-1]) for r in html_extract.LABELLED])
    print(html_extract.written(html_extract.default_tree()), right(html_extract.without_hint()))
    assert right(html_extract.default_tree()) == 1.0 and right(html_extract.without_hint()) > 0.8


def test_pages_without_article_or_names(spark):
    """Held-out pages whose elements say nothing: words and links of neighbours have to tell the text."""
    lost = extra = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        page = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", r["html"]).replace(' class="ad"', "")
        want = Counter(main_text(r["html"]).split())
        got = Counter(main_text(page).split())
        lost, extra, total = lost + (want - got).total(), extra + (got - want).total(), total + want.total()
    assert lost < 0.05 * total and extra < 0.05 * total, (lost, extra, total)


def test_deep_unclosed_tags_take_linear_time():
    block = "a few words that stand here alone in a block " * 3 + "of text"
    for page, want in (
        ("<div><span>" * 30_000 + block + "</b></i>" * 30_000, block),
        ("<i><b>" * 30_000 + block + "</i>" * 30_000, block),
        ("<b>" + "<font>" * 30_000 + block + "</b><b>" * 30_000, block),
    ):
        start = time.monotonic()
        assert main_text(page) == want
        assert time.monotonic() - start < 20


@pytest.mark.parametrize("deep", [0, 400, 600, 5000])
def test_clutter_below_many_unclosed_tags(deep):
    article = "<article><p>" + "The article has words enough to stay. " * 5 + "</p></article>"
    page = "<font>" * deep + article + "<footer><p>" + "foot words here " * 10 + "</p></footer><div class='comments'><p>" + "reader says this " * 10 + "</p></div>"
    assert main_text(page) == ("The article has words enough to stay. " * 5).strip()


def test_articles_of_the_pages(spark, sf_dir):
    import html

    for r in spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/pages.parquet").collect():
        inner = r["html"].partition("<article>")[2].partition("</article>")[0].partition("<footer>")[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))).split())
        assert main_text(r["html"]) == want


def test_long_text_of_many_matches(spark):
    n = 125_000
    start = time.monotonic()
    got = pii.detect(spark.createDataFrame([(1, "x@y.zz " * n)], "doc_id long, text string")).selectExpr("size(spans) AS n", "spans[0].end AS first", "spans[124999].start AS last").first()
    assert tuple(got) == (n, 6, 7 * (n - 1)) and time.monotonic() - start < 60


LOOSE_SPANS = {
    "mail me: john.doe [at] example [dot] com now": [("email", "john.doe [at] example [dot] com")],
    "from host 10[.]20[.]30[.]40 seen": [("ip", "10[.]20[.]30[.]40")],
    "card XXXX-XXXX-XXXX-1234 paid": [("card", "XXXX-XXXX-XXXX-1234")],
    "my card 4111.1111.1111.1111 ok": [("card", "4111.1111.1111.1111")],
    "call (555) 123-4567 now": [("phone", "(555) 123-4567")],
    'api_key = "a8f5f167f44f4964e6c998dee827110c" x': [("secret", "a8f5f167f44f4964e6c998dee827110c")],
    "commit a8f5f167f44f4964e6c998dee827110c": [],
    "hash a8f5f167f44f4964e6c998dee827110c.": [],
    "isbn 978-3-16-148410-0": [],
    "see the_quick_brown_fox_jumps_over_2_dogs": [],
    "on 2024-01-02 10:11:12, 555-123-4567": [],
    "token é😀 x@y.zz (at) home": [("email", "x@y.zz")],
}


def test_the_method_adds_loose_spans_of_each_kind(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = list(LOOSE_SPANS)
    planted = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] - 10**9: r["spans"] for r in pii.detect(docs.unionByName(planted)).where("doc_id >= 1000000000").collect()}
    for i, t in enumerate(texts):
        assert [(s["kind"], t[s["start"] : s["end"]]) for s in got[i]] == LOOSE_SPANS[t], t


def test_reliabilities_are_recovered():
    rng, sure, counts = np.random.default_rng(5), (0.95, 0.9, 0.8, 0.7, 0.6), defaultdict(int)
    truth = []
    for _ in range(20_000):
        kind = pii.KINDS[int(rng.integers(0, 2))]
        y = 1 if rng.random() < (0.7 if kind == "email" else 0.3) else -1
        votes = tuple(0 if rng.random() < 0.2 else y if rng.random() < s else -y for s in sure)
        counts[kind, votes] += 1
        truth.append((kind, votes, y))
    post, found = pii.reliabilities([(*k, n) for k, n in counts.items()])
    assert all(abs(found[j] - s) < 0.03 for j, s in zip(pii.LABELERS, sure, strict=True))
    assert np.mean([(post[k, v] > 0.5) == (y > 0) for k, v, y in truth]) > 0.93


def test_licenses_by_plain_search(spark):
    rows = [(1, "MIT License, GNU GPL"), (2, "x apache license y mit license z Apache; License"), (3, None), (4, "SPDX-License-Identifier: BSD-3-Clause OR ISC\nall"), (5, "the all rights reserved")]
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in licenses.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (4, 1, 0, 0, "mit", "gpl,mit", 1.0)
    assert got[2] == (9, 3, 1, 7, "apache,mit", "apache,mit", 1.0)
    assert got[3] == (0, 0, None, None, "", "", 0.0)
    assert got[4][1:4] == (0, None, None) and got[4][4:] == ("", "bsd,isc", 1.0)
    assert got[5][1] == 0 and got[5][5:] == ("proprietary", 0.7)


def test_bundles_by_hand():
    s, text = langid.Space(64), "Straße русский 漢字 Ελλάδα naïve "
    code = lambda ch: s._vector(0 if ch == " " else ord(ch)).astype(int)
    line = " "
    for ch in (c if c.isalpha() else " " for c in text.lower()):
        line += "" if ch == " " == line[-1] else ch
    want = sum(np.roll(code(line[i]), 2) * np.roll(code(line[i + 1]), 1) * code(line[i + 2]) for i in range(len(line) - 2))
    assert (want == s.bundle(s.counts(text))).all()


def test_language_ties_and_empty_models(spark):
    df = spark.createDataFrame([(1, "abc abc", "x"), (2, "abc abc", "w"), (3, "12", "x"), (4, "abc", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in langid.predict(df.select("doc_id", "text"), langid.fit(df)).collect()}
    assert got[1] == got[2] == ("w", 1.0) and got[3] == ("und", 0.0) and got[4][0] == "w"
    none = langid.fit(df.where("lang = 'none'"))
    assert none == {} and {r["lang_pred"] for r in langid.predict(df.select("doc_id", "text"), none).collect()} == {"und"}
