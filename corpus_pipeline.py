"""A training corpus from raw documents: five stages, each written as Parquet and read again.

The order is language ID, near-duplicates, benchmark decontamination, mixing, token files.  Each stage works
on all rows that its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import decontaminate, langid, mixing, near_dedup, token_blocks
from corpusweave.llm.common import new_path, unused
from corpusweave.llm.queries import table, tokenizer_path


ROWS = 1024  # rows that Python gets at once, so that long texts don't add up in memory


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language can be told, with their columns as they are; the model learns
    from all labelled documents but the held-out quarter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    learnt = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    lang, score = unused(docs, "lang_pred", "score")
    return langid.predict(docs, learnt, keep_text=True, into=(lang, score)).where(F.col(lang) != langid.UNKNOWN).drop(lang, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one with the smallest id."""
    return near_dedup.representatives(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target asks for."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the corpus as token blocks and returns what the files hold for each document."""
    return token_blocks.round_trip(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, with each result written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Language prototypes, minhash forests and tokenizer ids can't be written in SQL; tests compare each stage with brute force.
ORACLE_SQL = None
