"""Vector search over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.operators import vector as V
from trovesift.operators.merge import top_per_group
from trovesift.plans.relations import table, vectors


def _query_vector(spark, sf_dir, item=0):
    return [float(x) for x in vectors(spark, sf_dir).where(F.col("item_id") == item).first().embedding]


_DOT = "list_inner_product(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))"
_SIMS = "sims AS (SELECT e.vec_id AS item_id, e.label, {0} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {1}) q)"


def _sims(item):
    return _SIMS.format(_DOT, item)


def _similar(spark, sf_dir, item):
    q = F.array(*map(F.lit, _query_vector(spark, sf_dir, item)))
    return vectors(spark, sf_dir).select("item_id", "label", V.dot(F.col("embedding"), q).alias("cosine"))


@query(f"WITH {_sims(0)} SELECT item_id, round(cosine, 6) AS similarity FROM sims ORDER BY cosine DESC, item_id LIMIT 50")
def knn_exact(spark, sf_dir):
    return V.knn(vectors(spark, sf_dir), _query_vector(spark, sf_dir), 50).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_sims(3)} SELECT item_id, round(least(1.0, greatest(0.0, (cosine - 0.1) / 0.9)), 6) AS normalized FROM sims WHERE cosine >= 0.1 AND least(1.0, greatest(0.0, (cosine - 0.1) / 0.9)) > 0.05")
def cosine_normalized(spark, sf_dir):
    n = V.normalized_similarity(F.col("cosine"), 0.1)
    return _similar(spark, sf_dir, 3).where((F.col("cosine") >= 0.1) & (n > 0.05)).select("item_id", F.round(n, 6).alias("normalized"))


@query("SELECT vec_id AS item_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2, 1.0 AS norm_after FROM embeddings")
def l2_normalize(spark, sf_dir):
    v = vectors(spark, sf_dir).select("item_id", "embedding", V.normalize(F.col("embedding")).alias("n"))
    return v.select("item_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2"), F.round(V.dot(F.col("n"), F.col("n")), 4).alias("norm_after"))


@query(f"""WITH {_sims(1)}, tops AS (SELECT label, list_slice(list_sort(list(cosine), 'DESC'), 1, 3) AS t FROM sims GROUP BY label),
parts AS (SELECT label, t, t[1] AS best, list_sum(list_transform(t, lambda x: x * exp(x - t[1]))) / list_sum(list_transform(t, lambda x: exp(x - t[1]))) AS mean FROM tops)
SELECT label, round(best + (1 - best) * least(0.10, 0.03 * (len(t) - 1)) * least(1.0, greatest(0.0, (mean - 0.5) / 0.5)), 6) AS score FROM parts""")
def softmax_aggregate(spark, sf_dir):
    """Passages are the vectors of a label."""
    best = top_per_group(_similar(spark, sf_dir, 1), "label", [F.desc("cosine")], 3)  # only the best passages of each are gathered
    grouped = best.groupBy("label").agg(F.collect_list("cosine").alias("s"))
    return grouped.select("label", F.round(V.aggregate_passages(F.col("s")), 6).alias("score"))


def _list(sims, k):
    n = V.normalized_similarity(F.col("cosine"), 0.0)
    return sims.orderBy(F.desc("cosine"), "item_id").limit(k).select("item_id", n.alias("normalized"), "cosine")


@query(f"""WITH {_sims(1)}, {_sims(2).replace('sims AS', 'other AS')},
a AS (SELECT item_id, least(1.0, greatest(0.0, cosine)) AS normalized, cosine FROM sims ORDER BY cosine DESC, item_id LIMIT 40),
b AS (SELECT item_id, least(1.0, greatest(0.0, cosine)) AS normalized, cosine FROM other ORDER BY cosine DESC, item_id LIMIT 60)
SELECT item_id, round(least(1.0, sum(w)), 6) AS score, round(max(cosine), 6) AS cosine FROM (SELECT item_id, 0.6 * normalized AS w, cosine FROM a UNION ALL SELECT item_id, 0.4 * normalized, cosine FROM b) GROUP BY item_id""")
def dual_fusion(spark, sf_dir):
    fused = V.dual_fusion(_list(_similar(spark, sf_dir, 1), 40), _list(_similar(spark, sf_dir, 2), 60))
    return fused.select("item_id", F.round("score", 6).alias("score"), F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {_sims(5)}, s AS (SELECT item_id, row_number() OVER (ORDER BY cosine DESC, item_id) AS b FROM sims WHERE cosine > 0 QUALIFY b <= 40),
l AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS a FROM documents QUALIFY a <= 60)
SELECT coalesce(l.item_id, s.item_id) AS item_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'lexical_only' ELSE 'semantic_only' END AS category,
  round(coalesce(0.55 / (60 + a), 0) + coalesce(0.45 / (60 + b), 0), 9) AS score FROM l FULL JOIN s ON l.item_id = s.item_id""")
def rrf_merge(spark, sf_dir):
    semantic = _similar(spark, sf_dir, 5).where("cosine > 0").orderBy(F.desc("cosine"), "item_id").limit(40).select("item_id", F.col("cosine").alias("score"))
    lexical = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(60).select(F.col("doc_id").alias("item_id"), F.col("n_chars").alias("score"))
    return V.reciprocal_rank_fusion(lexical, semantic).withColumn("score", F.round("score", 9))


@query(f"""WITH {_sims(7)}, h AS (SELECT item_id, cosine, item_id % 7 = 0 AS o FROM sims),
r AS (SELECT item_id, cosine, CASE WHEN cosine >= 0.74 THEN 'high_similarity' WHEN o THEN 'lexical_overlap' WHEN cosine >= 0.3 THEN 'weak_lexical_semantic' END AS reason FROM h)
SELECT item_id, reason, row_number() OVER (ORDER BY cosine DESC, item_id) AS rank FROM r WHERE reason IS NOT NULL QUALIFY rank <= 8""")
def semantic_admission(spark, sf_dir):
    hits = _similar(spark, sf_dir, 7).select("item_id", F.col("cosine").alias("similarity"), (F.col("item_id") % 7 == 0).cast("int").alias("overlap"))
    return V.admit(hits, 0.74, 0.3, 8).select("item_id", "reason", "rank")


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings)
SELECT vec_id AS item_id, round((high - low) / 255, 9) AS scale, CAST(least(255, greatest(0, round(-low / ((high - low) / 255)))) AS INT) AS zero,
  list_sum(list_transform(v, lambda x: least(255, greatest(0, round(x / ((high - low) / 255)) + least(255, greatest(0, round(-low / ((high - low) / 255)))))) - 128))::BIGINT AS code_sum, TRUE AS close FROM p""")
def quantize_roundtrip(spark, sf_dir):
    q = vectors(spark, sf_dir).select("item_id", "embedding", V.quantize(F.col("embedding")).alias("q"))
    gap = F.array_max(F.zip_with(V.dequantize(F.col("q")), "embedding", lambda a, b: F.abs(a - b)))
    return q.select("item_id", F.round("q.scale", 9).alias("scale"), F.col("q.zero").alias("zero"), F.aggregate("q.data", F.lit(0), lambda a, x: a + x).cast("long").alias("code_sum"), (gap <= F.col("q.scale") * 1.01).alias("close"))


@query("SELECT v AS generation_id, n, v = 'v1' AS is_active FROM (SELECT 'v' || (label % 2 + 1) AS v, count(*) AS n FROM embeddings GROUP BY 1)")
def vector_generations(spark, sf_dir):
    v = vectors(spark, sf_dir).groupBy(F.concat(F.lit("v"), F.col("label") % 2 + 1).alias("generation_id")).agg(F.count("*").alias("n"))
    return V.activate(v, "v1")


@query("SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 3)")
def unembedded_anti(spark, sf_dir):
    done = vectors(spark, sf_dir).where("label <> 3").select("item_id")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")).join(done, "item_id", "left_anti")
