"""The registered queries of this subpackage: thin wrappers of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovesift.llm.shared import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from rows whose crc32(doc_id) mod 4 is not 2."""
    from trovesift.llm import langid

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences of at most 1024 tokens, as few as the search finds."""
    import public_tokenizers

    from trovesift.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, shuffled and written into eight shards by the key law, read back."""
    from trovesift.llm.sharding import shuffle_into_shards

    out = shuffle_into_shards(documents(spark, sf_dir).select("doc_id", "text"), shards=8)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word metrics of every text, and the verdict of the line-first rules."""
    from trovesift.llm.quality_rules import clean_documents

    return clean_documents(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents by two tokenizers, one's counts revised by the end id, and documents of under ten tokens deleted.

    Texts are read and counted once; revisions and deletes come from the stored counts.
    """
    import public_tokenizers

    from trovesift.llm import token_counts as tc
    from trovesift.llm.shared import materialize, scratch

    versions = {"byte_bpe_50k": "byte_bpe_50k.json", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
    docs = documents(spark, sf_dir).select("source", "lang", "text")
    counted = materialize(tc.bpe_counts(docs, {name: public_tokenizers.path(file) for name, file in versions.items()}).drop("text"), "counted")
    of = lambda df, version, n: df.select("source", "lang", F.lit(version).alias("tokenizer_version"), n.alias("n_tokens"))
    plain, multi = versions
    ledger = tc.Ledger(spark, scratch(spark, "ledger"))
    first = tc.inserts(of(counted, plain, F.col(plain)))
    ledger.commit("0-plain", first)
    ledger.commit("1-multi", tc.inserts(of(counted, multi, F.col(multi))))
    ended = counted.select("source", "lang", F.lit(multi).alias("tokenizer_version"), F.col(multi).alias("was"), (F.col(multi) + 1).alias("now"))
    ledger.commit("2-ended", tc.revised(ended, "was", "now"))
    short = counted.where(F.col(plain) < 10)
    ledger.commit("3-short", tc.deletes(of(short, plain, F.col(plain))).unionByName(tc.deletes(of(short, multi, F.col(multi) + 1))))
    ledger.commit("0-plain", first)  # a batch that comes twice counts once
    return ledger.totals()


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned from labels of rows whose crc32(doc_id) mod 5 is not 0."""
    from trovesift.llm import quality_clf

    docs = documents(spark, sf_dir).select("doc_id", "text")
    fold = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(5)) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold(F.col("doc_id")))
    model = quality_clf.fit(quality_clf.labelled_sample(docs, labels))
    return quality_clf.score_quality(docs, model).select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside 13-word windows of benchmark items."""
    from trovesift.llm.decontam import contamination

    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every text, learned from rows whose crc32(doc_id) mod 10 is not 0."""
    from trovesift.llm.lm import score_documents

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    return score_documents(documents(spark, sf_dir).select("doc_id", "text", held_out.alias("held_out")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    from trovesift.llm.ngram_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in seekable bundles, read back from the archives."""
    from trovesift.llm.warc import read_archives, write_archives

    path, manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(spark, path, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    from trovesift.llm.ranked_search import rank_documents

    return rank_documents(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), most=20)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the whole vectors with 64 components, after three rounds."""
    from trovesift.llm.clustering import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dimensions=64, scale=64, seed="1")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by a model of labelled pages that are not among them."""
    from trovesift.llm import html_extract

    model = html_extract.fit(html_extract.labelled_pages(spark))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_extract.extract_text(pages, model).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sizes
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    from trovesift.llm import clustering, decontam, quality_rules, ranked_search

    return {
        "op7_decontamination": decontam.ORACLE_SQL, "op4_quality_rules": quality_rules.ORACLE_SQL, "op9_ngram_jaccard_join": OP9_SQL,
        "op11_ranked_search": ranked_search.ORACLE_SQL, "op12_centroid_clustering": clustering.oracle_sql(),
    }
