"""Each operator on odd rows and on an empty table: no crash, the rows that its docstring promises."""

import pytest

from corpusweave.llm import decontaminate, html_extract, langid, licenses, mixing, near_dedup, pii, spotsigs, token_blocks, url_filter
from corpusweave.llm.queries import tokenizer_path

BENCH = "item_id long, text string"


def every(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "Alpha, beta"), (4, "alpha beta")], BENCH)
    return {
        "mix_amounts": mixing.mix_amounts,
        "spotsigs": spotsigs.edited_likeness,
        "fingerprints": spotsigs.fingerprints,
        "pii": pii.detect,
        "near": lambda d: near_dedup.near_duplicates(d, 2),
        "tokens": lambda d: token_blocks.round_trip(d, tokenizer_path()),
        "language": lambda d: langid.predict(d.select("doc_id", "text"), langid.fit(d.where(~langid.held_out(d["doc_id"])))),
        "licenses": licenses.detect,
        "contamination": lambda d: decontaminate.contamination(d, bench),
    }


NAMES = "mix_amounts spotsigs fingerprints pii near tokens language licenses contamination".split()


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_each_give_one_row(name, spark, odd):
    got = every(spark)[name](odd).select("doc_id").collect()
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table_gives_no_row(name, spark, none):
    assert every(spark)[name](none).count() == 0


def test_mix_and_dedup_keep_the_columns(spark, odd, none):
    assert mixing.mix(odd).columns == odd.columns
    assert near_dedup.representatives(odd, 2).columns == odd.columns
    assert near_dedup.representatives(none).count() == 0
    left = [r["doc_id"] for r in near_dedup.representatives(odd, 2).collect()]
    assert left.count(5) == 1 and 6 not in left and left.count(7) == 2 and {1, 2, 3, 4, 8, None} <= set(left)


def test_values_of_odd_rows(spark, odd):
    near = {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.near_duplicates(odd, 2).collect()}
    assert near[6, 5]["component_id"] == 5 and not near[6, 5]["kept"]
    assert near[1, 0]["kept"] and near[2, 0]["kept"] and near[4, 1]["kept"]
    tokens = {r["doc_id"]: r for r in token_blocks.round_trip(odd, tokenizer_path()).collect()}
    assert tokens[1]["n_tokens"] == tokens[2]["n_tokens"] == 1 and tokens[4]["n_tokens"] == 30_001
    found = {r["doc_id"]: r for r in decontaminate.contamination(odd, spark.createDataFrame([(3, "Alpha, beta"), (4, "alpha beta"), (5, None)], BENCH)).collect()}
    assert found[6]["n_hit"] == 2 and sorted(found[6]["item_ids"]) == [3, 4] and found[6]["contaminated"] and not found[7]["contaminated"]


def test_pages(spark):
    pages = "page_id long, url string, html string"
    rows = [(1, None, None), (2, "no scheme", ""), (2, "no scheme", ""), (3, "http://A.example.com", "<p>x" * 9000), (None, "x://", "<article>hi<script>no</script></article>")]
    df = spark.createDataFrame(rows, pages).selectExpr("*", "1 AS host", "2 AS rule", "3 AS node", "4 AS text")
    assert html_extract.extract(df).count() == url_filter.judge(df).count() == 5
    assert {r["page_id"]: (r["host"], r["path"], r["verdict"]) for r in url_filter.judge(df).collect()}[3] == ("a.example.com", "", "allow")
    assert html_extract.extract(df.limit(0)).count() == url_filter.judge(df.limit(0)).count() == 0


def test_contamination_in_greek_capitals_and_abbreviations(spark):
    texts = ["ΟΔΟΣ.ΑΘΗΝΑ", "Α.Σ. one", "ΤΙΣ'ΟΔΟΣ:Σ two", "AΣ.BΣ"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([*enumerate(texts[:3]), (3, "aΣ bΣ")], BENCH)
    for limit in (decontaminate.BLOCK, 3):
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, limit).collect()}
        assert {i: (r["item_ids"], r["n_hit"] == r["n_words"]) for i, r in got.items()} == {i: ([i], True) for i in range(4)}


def test_tokens_of_capitals_with_combining_marks():
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokenizer_path()), token_blocks.Encoder(tokenizer_path(), True)
    marks = "\u0308 \u030a \u030c \u0331 \u0323\u0331 \u0340 \u0344 \u0301".split()
    texts = ["H\u0331asan, T\u0308A! ÉCOLE Ünder", *(f"{x}{m}an {x}{m}AN, ({x}{m}) A{x}{m}. Über" for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks)]
    ids, lengths = own.encode_all(pa.array(texts))
    for text, got in zip(texts, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        assert np.array_equal(got[:-1], whole.encode(text, add_special_tokens=False).ids), ascii(text)


def test_tokens_of_the_dotted_capital_i_before_marks():
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokenizer_path()), token_blocks.Encoder(tokenizer_path(), True)
    texts = ["\u0130>", "x\u0130! y", "\u0130STANBUL, (\u0130)", "\u00d7\u00f7a\u00d7 \u00c7\u0130\u00f7 it's\u0130", "", " \t", "plain"]
    ids, lengths = own.encode_all(pa.array(texts))
    want = [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and lengths.tolist() == [len(x) for x in want]


def test_known_pieces_cost_less_than_a_list_of_them():
    from timeit import repeat

    import pyarrow as pa

    words = ["".join("abcdefghij"[int(d)] for d in f"{i:06d}") for i in range(60_000)]
    text, distinct, own = pa.array([" ".join(words)]), pa.array(words), token_blocks.Encoder(tokenizer_path(), True)
    own.encode_all(text)
    assert min(repeat(lambda: own.encode_all(text), number=1, repeat=7)) < min(repeat(distinct.to_pylist, number=1, repeat=7))


def test_representatives_shuffle_no_text_to_drop_rows(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(20)]
    docs = spark.createDataFrame([(i, texts[i % 20]) for i in range(50)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the names of dropped rows are beyond it
    try:
        left = near_dedup.representatives(docs)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert sorted(r["doc_id"] for r in left.collect()) == list(range(20))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
