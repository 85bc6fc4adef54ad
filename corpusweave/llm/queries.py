"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, exact_dedup, filter_audit, html_extract, langid, licenses, mixing, near_dedup, oracles, pii, spotsigs, token_blocks, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix_amounts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents"))


def op4_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.detect(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.filter(base, lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    total = F.size("spans").cast("long").alias("n_spans")  # with those that the method adds
    return got.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), total)


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return got.select("doc_id", "n_shingles", "component_id", "kept")


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text"), learnt)
    return got.select("doc_id", "held_out", "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.detect(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = align.with_pair_counts(align.aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digest=True))
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extract,
        op2_mix_sources,
        op3_spotsigs,
        op4_pii_weak,
        op5_minhash_forest,
        op6_redirect_filter,
        op7_token_blocks,
        op8_language_id,
        op9_license_scan,
        op10_decontaminate,
        op11_cross_tokenizer,
        op12_exact_dedup,
        op13_filter_audit,
    )
}
ORACLE_SQL = {
    "op2_mix_sources": oracles.MIX,
    "op6_redirect_filter": oracles.URLS,
    "op10_decontaminate": oracles.CONTAMINATION,
    "op12_exact_dedup": oracles.COPIES,
    "op13_filter_audit": oracles.AUDIT,
}
