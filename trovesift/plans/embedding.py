"""Embeddings, their upkeep and their index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.operators import embedding as E
from trovesift.operators import graph
from trovesift.operators import vector as V
from trovesift.plans.relations import table, vectors
from trovesift.plans.vectors import _query_vector
from trovesift.sources.scratch import shared_folder


@query("""WITH RECURSIVE s AS (SELECT doc_id, CAST('0x' || md5('7:' || coalesce(text, ''))[1:8] AS BIGINT) AS x, 0 AS k FROM documents
  UNION ALL SELECT doc_id, (x * 1664525 + 1013904223) % 4294967296, k + 1 FROM s WHERE k < 16),
v AS (SELECT doc_id, k, (x % 65536) / 65535.0 * 2.0 - 1.0 AS u FROM s WHERE k > 0)
SELECT doc_id, round(max(u) FILTER (WHERE k = 1) / sqrt(sum(u * u)), 6) AS first, round(max(u) FILTER (WHERE k = 16) / sqrt(sum(u * u)), 6) AS last, round(sum(u) / sqrt(sum(u * u)), 6) AS total FROM v GROUP BY doc_id""")
def fake_embeddings(spark, sf_dir):
    """Vectors that follow from the texts alone."""
    rows = E.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), None, 16).withColumn("e", E.deterministic(F.coalesce("text", F.lit("")), 16, 7))
    return rows.select("doc_id", F.round(F.col("e")[0], 6).alias("first"), F.round(F.col("e")[15], 6).alias("last"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE vec_id % 4 = 0) AS deleted, count(*) > 0 AND count(*) FILTER (WHERE vec_id % 4 = 0) > 0.2 * count(*) AS rebuild FROM embeddings""")
def vector_rebuild_needed(spark, sf_dir):
    v = vectors(spark, sf_dir).select("item_id", F.lit(False).alias("is_deleted"))
    return E.needs_rebuild(E.mark_deleted(v, v.where("item_id % 4 = 0")))


@query("SELECT doc_id AS item_id, round(CASE WHEN max(n_chars) OVER () > 0 THEN n_chars / max(n_chars) OVER () ELSE 0 END, 9) AS score FROM documents WHERE n_chars IS NOT NULL")
def lexical_normalized(spark, sf_dir):
    """Scores as shares of the highest; the highest is one aggregated row, joined to all."""
    docs = table(spark, sf_dir, "documents").where("n_chars is not null").select(F.col("doc_id").alias("item_id"), F.col("n_chars").cast("double").alias("score"))
    highest = docs.agg(F.max("score").alias("highest"))
    return docs.join(F.broadcast(highest)).select("item_id", F.round(V.normalized_lexical(F.col("score"), F.col("highest")), 9).alias("score"))


@query()
def knn_index(spark, sf_dir):
    """The 50 nearest by an inverted file of 16 lists, 12 of them read; a test measures its recall against the exact search."""
    index = E.InvertedFile.build(vectors(spark, sf_dir), shared_folder(spark, "lists"))
    return index.search(_query_vector(spark, sf_dir), 50).withColumn("similarity", F.round("similarity", 6))


#: A small vocabulary: marks, letters, and some frequent pieces.
_PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *".,!?;:", *"abcdefghijklmnopqrstuvwxyz0123456789", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz0123456789"), "the", "der", "die", "and", "##en", "##er", "##ing", "##tion"]


@query()
def wordpiece_tokens(spark, sf_dir):
    ids = E.wordpiece({p: k for k, p in enumerate(_PIECES)})
    return table(spark, sf_dir, "documents").select("doc_id", ids("text").alias("ids")).select("doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("digest"))


@query()
def vector_rebuild(spark, sf_dir):
    """Vectors of a new generation, of the first passages of each item."""
    from trovesift.functions import text

    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.inline(text.chunks(text.clean(F.col("text")))))
    return E.rebuild(chunks, None, 16).select("item_id", "passage", F.round(F.col("embedding")[0], 6).alias("first"))


_GRAPHS: dict[tuple[str, str], graph.GraphIndex] = {}


@query()
def graph_search(spark, sf_dir):
    """The ten nearest of every hundredth vector by a graph that grew: built of two thirds of the vectors, the rest linked in, those of label 9 marked; tests measure recall and what is touched."""
    key = spark.sparkContext.applicationId, sf_dir
    v = vectors(spark, sf_dir)
    if key not in _GRAPHS:
        made = graph.GraphIndex.build(v.where("item_id % 3 > 0 or label = 9"), shared_folder(spark, "graph"))
        _GRAPHS[key] = made.add(v.where("item_id % 3 = 0 and label <> 9")).delete(v.where("label = 9"))
    asked = v.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding")
    return _GRAPHS[key].search(asked, 10).select("query_id", "rank", "item_id", F.round("similarity", 4).alias("similarity"))


@query("""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, item_id) AS INTEGER) AS rank, item_id, round(s, 6) AS similarity FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS item_id, list_inner_product(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)) AS s
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) QUALIFY rank <= 10""")
def knn_batch(spark, sf_dir):
    """The exact ten nearest of every hundredth vector, all queries in one pass."""
    v = vectors(spark, sf_dir)
    found = V.knn_batch(v, v.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding"), 11)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", "rank", "item_id", F.round("similarity", 6).alias("similarity"))
