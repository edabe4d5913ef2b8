"""Answers, cascade and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.operators import answers as A
from trovesift.operators import merge
from trovesift.plans.lexical import index
from trovesift.plans.relations import CONTENT, EXTENSIONS, ITEMS, as_of, content, feedback, items, table, vectors, with_
from trovesift.plans.vectors import _query_vector


_SCORE = "round(1.45 * n / 3.0 + 0.05 - CASE WHEN length(s) > 340 THEN 0.12 WHEN length(s) < 26 THEN 0.14 ELSE 0.0 END, 9)"


@query(with_(CONTENT) + rf"""SELECT item_id, md5(arg_max(s[1:240], (score, -position))) AS sentence_md5, max(score) AS score FROM (
  SELECT item_id, s, position, {_SCORE} AS score FROM (
  SELECT item_id, s, position, len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')), ['license', 'version', 'public'])) AS n
  FROM (SELECT item_id, unnest(parts) AS s, unnest(range(len(parts))) AS position FROM (SELECT item_id, string_split(regexp_replace(chunk_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM content)) WHERE length(s) >= 18))
WHERE score >= 0.20 GROUP BY item_id""")
def answer_sentence(spark, sf_dir):
    return A.best_sentences(content(spark, sf_dir), ["license", "version", "public"]).select("item_id", F.md5("sentence").alias("sentence_md5"), "score")


@query("""WITH h AS (SELECT doc_id AS item_id, n_chars / 1000.0 AS score, (doc_id % 8) / 8.0 AS fast, (doc_id % 5) / 5.0 AS strong, CASE doc_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.1 ELSE 0.3 END AS semantic
  FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40),
f AS (SELECT *, score + CASE WHEN fast >= 0.05 THEN 2.0 * fast ELSE 0 END AS after FROM h),
r AS (SELECT *, row_number() OVER (ORDER BY after DESC, item_id) AS rank, after - lead(after) OVER (ORDER BY after DESC, item_id) AS lead FROM f),
g AS (SELECT *, coalesce((SELECT lead FROM r WHERE rank = 1) < 0.08, FALSE) OR ((SELECT count(*) FROM r WHERE rank <= 10 AND semantic >= 0.55) >= 3 AND (SELECT count(*) FROM r WHERE rank <= 10 AND semantic <= 0.12) >= 3) AS ambiguous FROM r)
SELECT item_id, ambiguous, round(after + CASE WHEN ambiguous AND rank <= 12 AND strong >= 0.10 THEN 4.0 * strong ELSE 0 END, 6) AS score FROM g""")
def cascade_two_pass(spark, sf_dir):
    k = F.col("doc_id")
    semantic = F.when(k % 3 == 0, 0.9).when(k % 3 == 1, 0.1).otherwise(0.3)
    hits = table(spark, sf_dir, "documents").select(k.alias("item_id"), (F.col("n_chars") / 1000.0).alias("score"), (k % 8 / 8.0).alias("f"), (k % 5 / 5.0).alias("s"), semantic.alias("semantic"))
    ranked = A.cascade(hits, F.col("f"), F.col("s"), F.col("semantic"), weights=(2.0, 4.0))
    return ranked.select("item_id", "ambiguous", F.round("score", 6).alias("score"))


@query()
def hybrid_search(spark, sf_dir):
    """Both sides, fused and boosted; its parts have oracles of their own."""
    return A.hybrid_search(index(spark, sf_dir), items(spark, sf_dir), vectors(spark, sf_dir), merge.open_counts(feedback(spark, sf_dir)), "report from january in my documents with pdf", _query_vector(spark, sf_dir), as_of())


@query(with_(ITEMS) + """, r AS (SELECT item_id, extension, name, path, size, row_number() OVER (PARTITION BY extension ORDER BY size DESC, item_id) AS n FROM items),
q AS (SELECT *, 'best ' || extension AS query, 1 / (1 + exp(-(item_id % 9 - 4))) AS p FROM r WHERE n <= 40)
SELECT query, item_id, name || ' | ' || regexp_extract(path, '^(.*)/', 1) || ' | a hit of ' || name AS document, round(CASE WHEN p >= 0.1 THEN 35.0 * p ELSE 0.0 END, 6) AS boost FROM q""")
def rerank_pairs(spark, sf_dir):
    """Each query with its best hits, as texts for a reranker, and the boost that a logit gives."""
    i = items(spark, sf_dir)
    hits = i.select(F.col("extension").alias("query_id"), "item_id", F.col("size").alias("score"), "name", "path", F.concat(F.lit("a <b>hit</b> of "), "name").alias("snippet"))
    queries = spark.createDataFrame([(x, f"best {x}") for x in EXTENSIONS], "query_id string, query string")
    return A.rerank_pairs(queries, hits).select("query", "item_id", "document", F.round(A.cross_boost((F.col("item_id") % 9 - 4).cast("double"), 35.0), 6).alias("boost"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS b FROM embeddings),
s AS (SELECT vec_id, a, b, unnest(range(1, 65)) AS s FROM v), p AS (SELECT vec_id, s, unnest(range(s, least(64, s + 30) + 1)) AS e, a, b FROM s),
r AS (SELECT vec_id, s, e, a[s] + b[e] AS score, row_number() OVER (PARTITION BY vec_id ORDER BY a[s] + b[e] DESC, s, e) AS n FROM p)
SELECT vec_id, s - 1 AS first, e - 1 AS last, round(score, 6) AS score, round(1 / (1 + exp(-score / 6)), 6) AS confidence FROM r WHERE n = 1""")
def answer_span(spark, sf_dir):
    """The best span by start and end logits; vectors stand for them."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors(spark, sf_dir).select("item_id", A.best_span(v, F.reverse(v)).alias("s"))
    return rows.select(F.col("item_id").alias("vec_id"), "s.first", "s.last", F.round("s.score", 6).alias("score"), F.round("s.confidence", 6).alias("confidence"))
