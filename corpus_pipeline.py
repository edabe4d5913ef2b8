"""A corpus pipeline of five stages: each reads what its predecessor kept, written as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovesift.llm import decontam, langid, ngram_join, packing, quality_rules, shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, with a score of a half or more."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, with the failed lines gone."""
    kept = quality_rules.keep_clean(docs)
    return kept.withColumn("text", F.col("cleaned_text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Where doc_ids are null or repeated, rows are told apart by their place, and the first one stays.
    """
    rows, key = docs, "doc_id"
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        key = "_row"
        rows = shared.materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = ngram_join.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), n=5, percent=80)
    gone = shared.materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "gone")
    if gone.count() <= ngram_join.TOLD_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark windows."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("not contaminated").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        before, since = docs, shared.made()
        docs = shared.materialize(stage(spark, before, sf_dir), name)
        shared.sweep(spark, since, docs)
        shared.discard(before)
    return docs


#: SQL has neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None
