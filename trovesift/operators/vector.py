"""Vector search and fusion of ranked lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovesift.config import DEFAULTS, Settings


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """L2: a null vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k items with the highest inner product: exact, one pass, partial top-k in each task."""
    return vectors.select("item_id", dot(F.col("embedding"), F.array(*map(F.lit, query))).alias("similarity")).orderBy(F.desc("similarity"), "item_id").limit(k)


#: Numbers of the queries that a task holds at once.
TOLD_NUMBERS = 1 << 22


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, similarity): for each query (query_id, embedding, and perhaps mask) the `k` vectors (item_id, embedding, bits) with the highest inner product, smaller ids first.

    Exact: every task multiplies its vectors with all queries, in blocks of queries of
    bounded size, and keeps `k` for each, so `k` rows a task and query are shuffled. With
    masks, a query sees vectors that have one of its bits; a mask of 0 sees all. Null
    embeddings find nothing; vectors of another length than the queries' fail.
    """
    masked = "mask" in queries.columns
    asked = queries.where("embedding is not null").select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), (F.col("mask") if masked else F.lit(0)).cast("long").alias("mask"))
    size = asked.agg(F.sum(F.size("embedding"))).first()[0] or 0
    blocks = max(1, -(-size // TOLD_NUMBERS))
    rows = vectors.select("item_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), (F.col("bits") if masked else F.lit(0)).cast("long").alias("bits")).where("embedding is not null")
    parts = []
    for block in range(blocks):
        own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
        if own.num_rows:
            parts.append(_nearest(rows, own, k))
    if not parts:
        return rows.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "item_id", F.lit(0.0).alias("similarity")).limit(0)
    names = queries.select("query_id").schema
    best = parts[0]
    for more in parts[1:]:
        best = best.unionByName(more)
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))).where(F.col("_r") <= k)
    return ranked.select(F.col("query_id").cast(names["query_id"].dataType).alias("query_id"), "item_id", "similarity")


def _nearest(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    matrix = np.stack([np.asarray(v, float) for v in asked.column("embedding").to_pylist()])
    told = rows.sparkSession.sparkContext.broadcast((asked.column("query_id").to_pylist(), matrix, asked.column("mask").to_numpy()))

    def run(batches):
        ids, queries, masks = told.value
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        least = np.full(len(ids), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                item, bits = part.column(0).to_numpy(), part.column(2).to_numpy()
                found = part.column(1).flatten().to_numpy().reshape(len(item), queries.shape[1]) @ queries.T
                if masks.any():
                    found[((bits[:, None] & masks[None, :]) == 0) & (masks != 0)[None, :]] = -np.inf
                for q in np.flatnonzero(((found >= least) & (found > -np.inf)).any(0)).tolist():
                    near = np.flatnonzero((found[:, q] >= least[q]) & (found[:, q] > -np.inf))
                    value, place = np.concatenate([best[q][0], found[near, q]]), np.concatenate([best[q][1], item[near]])
                    order = np.lexsort((place, -value))[:k]
                    best[q] = value[order], place[order]
                    if len(order) == k:
                        least[q] = value[order[-1]]
        for q, (value, place) in enumerate(best):
            if len(value):
                yield pa.RecordBatch.from_arrays([pa.array([str(ids[q])] * len(value)), pa.array(place), pa.array(value)], ["query_id", "item_id", "similarity"])

    return rows.mapInArrow(run, "query_id string, item_id long, similarity double")


def normalized_similarity(cosine: Column, threshold: float | Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - threshold) / (1 - threshold)))


def aggregate_passages(sims: Column, s: Settings = DEFAULTS) -> Column:
    """An item's score from its passages' similarities: the best, and a bonus for support by the next ones."""
    top = F.slice(F.sort_array(sims, asc=False), 1, s.passage_cap)
    best = F.element_at(top, 1)
    total = F.aggregate(F.transform(top, lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(F.transform(top, lambda x: x * F.exp(x - best)), F.lit(0.0), lambda a, x: a + x) / total
    support = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mean - 0.5) / 0.5))
    bonus = F.least(F.lit(0.10), 0.03 * (F.size(top) - 1))
    return F.when(F.size(top) > 0, best + (1 - best) * bonus * support)


def dual_fusion(strong: DataFrame, fast: DataFrame, weights: tuple[float, float] = (0.60, 0.40)) -> DataFrame:
    """(item_id, score, cosine) of two indexes' hits (item_id, normalized, cosine): weighted sum, one at most, and the best cosine."""
    part = lambda df, w: df.select("item_id", (F.col("normalized") * w).alias("w"), "cosine")
    both = part(strong, weights[0]).unionByName(part(fast, weights[1]))
    return both.groupBy("item_id").agg(F.least(F.lit(1.0), F.sum("w")).alias("score"), F.max("cosine").alias("cosine"))


def reciprocal_rank_fusion(lexical: DataFrame, semantic: DataFrame, weights: tuple[float, float] = (0.55, 0.45), s: Settings = DEFAULTS) -> DataFrame:
    """(item_id, category, score) of hits (item_id, score) of both sides; semantic hits without score go. The lists are top-k, not tables."""
    ranked = lambda df, name: df.select("item_id", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")).alias(name))
    joined = ranked(lexical, "a").join(ranked(semantic.where("score > 0"), "b"), "item_id", "full_outer")
    part = lambda rank, w: F.coalesce(w / (s.rrf_k + F.col(rank)), F.lit(0.0))
    category = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "lexical_only").otherwise("semantic_only")
    return joined.select("item_id", category.alias("category"), (part("a", weights[0]) + part("b", weights[1])).alias("score"))


def admit(hits: DataFrame, safety: float, relaxed: float, cap: int, weak_natural: bool = True) -> DataFrame:
    """Semantic-only hits (item_id, similarity, overlap) with the reason they are let in, the best `cap` of them.

    The relaxed bar holds only for natural language with weak lexical hits. The best `cap` are found before they are ranked.
    """
    reason = F.when(F.col("similarity") >= safety, "high_similarity").when(F.col("overlap") > 0, "lexical_overlap")
    if weak_natural:
        reason = reason.when(F.col("similarity") >= relaxed, "weak_lexical_semantic")
    top = hits.withColumn("reason", reason).where("reason is not null").orderBy(F.desc("similarity"), "item_id").limit(cap)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "item_id")))


def normalized_lexical(score: Column, highest: Column) -> Column:
    """A lexical score as a share of the highest; 0 if that isn't positive."""
    return F.when(highest > 0, score / highest).otherwise(0.0)


def quantize(v: Column) -> Column:
    """struct(scale, zero, data): affine codes from -128 to 127 with an integer zero point; a constant vector has scale 0 and codes 0."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    scale = F.when((high - low) / 255 > 1.1920929e-07, (high - low) / 255).otherwise(0.0)
    zero = F.when(scale > 0, F.least(F.lit(255), F.greatest(F.lit(0), F.round(-low / scale).cast("int")))).otherwise(0)
    code = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.round(x.cast("double") / scale).cast("int") + zero)) - 128
    data = F.transform(v, lambda x: F.when(scale > 0, code(x)).otherwise(0))
    return F.struct(scale.alias("scale"), zero.alias("zero"), data.alias("data"))


def dequantize(q: Column) -> Column:
    return F.transform(q["data"], lambda x: F.when(q["scale"] > 0, (x + 128 - q["zero"]) * q["scale"]).otherwise(0.0))


def activate(state: DataFrame, generation: str) -> DataFrame:
    """Vector generations with exactly one of them active."""
    return state.withColumn("is_active", F.col("generation_id") == generation)
