import random
import re
from collections import Counter

import duckdb

import corpus_pipeline
from corpusweave.llm import decontaminate, langid, mixing, near_dedup, queries, url_filter
from corpusweave.llm.common import connected_components, key_splits, range_of

PAGES = "page_id long, url string, html string"


def test_blocks_reach_aliases_unless_one_is_allowed(spark):
    link = '<head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://x.example.com/en/5", None),
        (2, "http://mirror.example.edu/a", link.format("http://x.example.com/en/5#top")),
        (3, "http://mirror.example.edu/b", link.format("/a")),
        (4, "http://other.example.edu/c", '<meta http-equiv="refresh" content="0; url=http://x.example.com/en/9">'),
        (5, "http://x.example.com/en/9", link.format("http://x.example.com/en/7")),
        (6, "http://alone.example.edu/", None),
    ]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1] == ("com/en/", "block") and got[2] == got[3] == (None, "block")
    assert got[4] == (None, "allow") and got[5] == ("com/en/", "block") and got[6] == (None, "allow")


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(200)} | {1000 + i: 1000 for i in range(61)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranges(spark):
    df = spark.range(1000)
    splits = key_splits(df, "id", 8)
    want = {i: sum(s <= i for s in splits) for i in range(1000)}
    assert {r["id"]: r["p"] for r in df.select("id", range_of(df["id"], splits).alias("p")).collect()} == want


def test_sql_of_the_queries(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, text in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), c.execute(text).df()
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        rows = [sorted(tuple(map(str, r)) for r in x[names].itertuples(index=False)) for x in (got, want)]
        assert rows[0] == rows[1], name


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learnt = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    named = {r["doc_id"] for r in langid.predict(docs.select("doc_id", "text"), learnt).where("lang_pred <> 'und'").collect()}
    first = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert {r["doc_id"] for r in first.collect()} == named and first.columns == docs.columns
    second = corpus_pipeline.drop_near_duplicates(spark, first, sf_dir)
    kept = {r["doc_id"] for r in near_dedup.near_duplicates(first).where("kept").collect()}
    assert {r["doc_id"] for r in second.collect()} == kept and second.columns == docs.columns
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_relative_links_are_resolved(spark):
    link = '<head>{}<link rel="canonical" href="{}"></head>'
    page = "http://h.edu/de/a/5?q=1#f"
    cases = [
        (page, "", "7", "http://h.edu/de/a/7"),
        (page, "", "../8", "http://h.edu/de/8"),
        (page, "", "./x/../y/.", "http://h.edu/de/a/y/"),
        (page, "", "../../../z?u=http://o.edu/../b#t", "http://h.edu/z?u=http://o.edu/../b#t"),
        (page, "", "..", "http://h.edu/de/"),
        (page, "", "?id=3&amp;k", "http://h.edu/de/a/5?id=3&k"),
        (page, "", "/en/../9", "http://h.edu/9"),
        (page, "", "\n http://o.edu/k\n", "http://o.edu/k"),
        (page, "", "//o.edu/k", "http://o.edu/k"),
        (page, "", "https://o.edu/a/../b", "https://o.edu/a/../b"),
        ("http://h.edu", "", "7", "http://h.edu/7"),
        ("http://h.edu?q", "", "?id=3", "http://h.edu?id=3"),
        (page, "<base target=x><base href='/b/c'>", "7", "http://h.edu/b/7"),
        (page, "<base href='http://o.edu/k/'>", "../7", "http://o.edu/7"),
        (page, "", "mailto:a@b", None),
        (page, "", "javascript:go('http://o.edu')", None),
        (page, "", "#top", None),
        (page, "", "", None),
    ]
    for url, base, target, want in cases:
        got = url_filter.page_links(spark.createDataFrame([(url, link.format(base, target))], "url string, html string")).collect()
        assert [r["target"] for r in got] == ([want] if want else []), target


def test_blocks_reach_aliases_by_relative_links(spark):
    rows = [
        (1, "http://x.example.com/en/5", '<link rel=canonical href="../a/b">'),
        (2, "http://x.example.com/a/b", None),
        (3, "http://x.example.com/a/c?k", "<meta http-equiv=refresh content='0; url=b'>"),
        (4, "http://x.example.com/en/6", '<link rel=canonical href="../d">'),
        (5, "http://x.example.com/d", '<link rel=canonical href="en/7">'),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_links_that_are_none_and_references(spark):
    page = "http://h.edu/de/a/5"
    cases = [
        ('<!-- <link rel=canonical href="/x"> -->', None),
        ('<script>var a = \'<link rel=canonical href="/x">\'</script>', None),
        ('<link rel=canonical data-href="/x">', None),
        ('<!-- > --><link rel="canonical" href="/x?a=1&amp;b=2&#38;c&#x3d;3">', "http://h.edu/x?a=1&b=2&c=3"),
        ("<link href='/\u00e9&#233;&#x1F600;' rel='canonical'>", "http://h.edu/\u00e9\u00e9\U0001f600"),
    ]
    for html, want in cases:
        got = url_filter.page_links(spark.createDataFrame([(page, html)], "url string, html string")).collect()
        assert [r["target"] for r in got] == ([want] if want else []), html


def test_generated_pages_with_links_against_sql(spark, tmp_path):
    rng = random.Random(4)
    hosts, paths = ["a.example.com", "example.com", "b.example.net", "c.org", "d.edu", "e.info"], ["/en/7", "/en/5", "/de/8", "/de/1", "/es/2", "/fr/3"]
    urls = [f"http://{h}{p}{k}" for h in hosts for p in paths for k in range(4)]
    rows = []
    for i, u in enumerate(urls):
        t = rng.choice(urls)
        kind = rng.random()
        html = f'<link rel="canonical" href="{t}">' if kind < 0.4 else f'<meta http-equiv="refresh" content="0;url={t}">' if kind < 0.6 else "<p>x" if kind < 0.8 else None
        rows.append((i, u, html))
    df = spark.createDataFrame(rows, PAGES)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.execute(queries.ORACLE_SQL["op6_redirect_filter"]).fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["op6_redirect_filter"](spark, str(tmp_path)).collect())
    assert got == want and {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, sf_dir):
    for docs in (odd, none):
        got, rows = docs, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, got, sf_dir)
            assert name == "tokens" or got.columns == docs.columns
            assert rows or got.count() == 0
    ids = [r["doc_id"] for r in got.collect()]
    assert ids == []


def test_last_stages_by_brute_force(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = corpus_pipeline.decontaminate_benchmark(spark, docs, sf_dir)
    bad = {r["doc_id"] for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad and bad
    mixed = corpus_pipeline.mix_sources(spark, clean, sf_dir)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_amounts(clean).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert all(words[i] == n for i, n in taken.items())
    tokens = Counter(r["doc_id"] for r in corpus_pipeline.write_tokens(spark, mixed, sf_dir).collect())
    assert tokens == Counter(r["doc_id"] for r in mixed.collect())
