"""Extractive answers, two-pass reranking and the hybrid search that puts the operators together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovesift.config import DEFAULTS, Settings
from trovesift.functions import scoring as S
from trovesift.functions.paths import directory, matches_any
from trovesift.operators import fulltext, understanding, vector


def best_sentences(chunks: DataFrame, terms: list[str], phrase: str = "", most_chars: int = 240) -> DataFrame:
    """(item_id, sentence, score) of the sentence of each item that answers best, if any does.

    chunks (item_id, chunk_index, chunk_text). Overlap with the terms counts most, the
    phrase and early chunks add, very long or short sentences lose.
    """
    wanted = F.array(*map(F.lit, terms))
    split = F.posexplode(F.split("chunk_text", r"(?<=[.!?])\s+")).alias("position", "sentence")
    rows = chunks.select("item_id", "chunk_index", split).where(F.length("sentence") >= 18)
    words = F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    share = F.size(F.array_intersect(words, wanted)) / F.lit(float(max(1, len(terms))))
    size = F.length("sentence")
    score = 1.45 * share + (F.when(F.lower("sentence").contains(phrase.lower()), 0.35).otherwise(0.0) if phrase else F.lit(0.0)) + 0.05 / (1 + F.col("chunk_index"))
    score = score - F.when(size > 340, 0.12).when(size < 26, 0.14).otherwise(0.0)
    scored = rows.withColumn("score", F.round(score, 9)).where("score >= 0.20")
    best = scored.groupBy("item_id").agg(F.max(F.struct("score", -F.col("chunk_index"), -F.col("position"), "sentence")).alias("b"))
    return best.select("item_id", F.substring("b.sentence", 1, most_chars).alias("sentence"), F.col("b.score").alias("score"), F.round(F.least(F.lit(1.0), F.col("b.score") / 1.8), 6).alias("confidence"))


def cascade(hits: DataFrame, fast: Column, strong: Column, semantic: Column | None = None, weights: tuple[float, float] = (19.25, 35.0), least: tuple[float, float] = (0.05, 0.10), first: int = 40, second: int = 12, margin: float = 0.08) -> DataFrame:
    """`hits` (item_id, score) after both passes: `fast` (a score from 0 to 1) on the top `first`, `strong` on the top `second` if the order is in doubt.

    A pass adds its weight times its score, from `least` on. The order is in doubt if the
    lead of the first is below `margin`, or if three of the top ten or more have a
    `semantic` of 0.55 and three one of 0.12 or less. Works on a top-k list; row caps take
    the place of time budgets.
    """
    order = Window.orderBy(F.desc("score"), "item_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    boost = lambda score, k: F.when(score >= least[k], weights[k] * score).otherwise(0.0)
    ranked = hits.orderBy(F.desc("score"), "item_id").limit(first)
    ranked = ranked.withColumn("fast", boost(fast, 0)).withColumn("score", F.col("score") + F.col("fast"))
    again = ranked.withColumn("rank", F.row_number().over(order)).withColumn("lead", F.col("score") - F.lead("score").over(order))
    doubt = F.coalesce(F.first("lead").over(whole) < margin, F.lit(False))
    if semantic is not None:
        among = lambda rule: F.sum(F.when((F.col("rank") <= 10) & rule, 1).otherwise(0)).over(whole)
        doubt = doubt | ((F.count("*").over(whole) >= 2) & (among(semantic >= 0.55) >= 3) & (among(semantic <= 0.12) >= 3))
    again = again.withColumn("ambiguous", doubt)
    again = again.withColumn("strong", F.when(F.col("ambiguous") & (F.col("rank") <= second), boost(strong, 1)).otherwise(0.0))
    return again.withColumn("score", F.col("score") + F.col("strong")).drop("lead")


def hybrid_search(chunks: DataFrame | fulltext.Index, items: DataFrame, vectors: DataFrame, opens: DataFrame, query: str, embedding: list[float], now: Column, filters: Column | None = None, limit: int = 20, s: Settings = DEFAULTS, rerank: Callable | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Ranked items (item_id, path, category, fused, boosts, score) for one query: one plan from candidates to the top.

    The query is understood on the driver; candidates of both sides are top-k lists, so
    what is joined with the catalog is bounded by their limits. `chunks` may be an index.
    """
    limit = min(200, max(1, limit))
    if ignored:  # patterns may be newer than the index
        keep = ~matches_any(F.col("path"), ignored)
        filters = keep if filters is None else filters & keep
    allowed = items if filters is None else items.where(filters)
    found = fulltext.ranked(chunks, fulltext.sanitize_relaxed(query), every=False, settings=s)  # statistics are the whole corpus's, whatever the filters
    lexical = fulltext.best_chunks(found if filters is None else found.join(allowed.select("item_id"), "item_id", "left_semi"))
    lexical = lexical.select("item_id", (-F.col("rank")).alias("score")).orderBy(F.desc("score"), "item_id").limit(4 * limit)
    near = vector.knn(vectors.join(allowed.select("item_id"), "item_id", "left_semi"), embedding, 2 * limit)
    semantic = near.select("item_id", vector.normalized_similarity(F.col("similarity"), 0.1).alias("score"))
    fused = vector.reciprocal_rank_fusion(lexical, semantic, s=s).withColumnRenamed("score", "fused")
    rows = fused.join(allowed, "item_id").join(opens, "item_id", "left")
    c = F.col
    hints = understanding.hints(query)
    boosts = (
        S.recency(c("modified_at"), now, s) * 0.25 + S.frequency(c("open_count"), c("last_open"), now, s) * 0.5 + S.pinned(c("is_pinned"), s)
        + S.hint_boost(hints, c("path"), c("extension"), c("modified_at"))
    )
    scored = rows.withColumn("boosts", boosts).withColumn("score", F.greatest(F.lit(0.0), 1000 * c("fused") + c("boosts") - S.junk(c("path"), s)))
    if rerank is not None:
        scored = rerank(scored)
    return scored.select("item_id", "path", "category", F.round("fused", 9).alias("fused"), F.round("boosts", 6).alias("boosts"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "item_id").limit(limit)


def document_text(name: Column, path: Column, snippet: Column) -> Column:
    """What a reranker reads of a hit: name, folder and plain snippet, as far as there are any."""
    plain = F.regexp_replace(F.coalesce(snippet, F.lit("")), "</?b>", "")
    folder = directory(path)
    return F.concat_ws(" | ", name, F.when(folder != "", folder), F.when(plain != "", plain))


def rerank_pairs(queries: DataFrame, hits: DataFrame, most: int = 40) -> DataFrame:
    """(query, item_id, document) of each query (query_id, query) with its `most` best hits (query_id, item_id, score, name, path, snippet)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    top = hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return top.join(queries, "query_id").select("query_id", "query", "item_id", document_text(F.col("name"), F.col("path"), F.col("snippet")).alias("document"))


def cross_boost(logit: Column, weight: float, least: float = 0.1) -> Column:
    """A reranker's boost: weight times the logistic of its logit, from `least` on."""
    score = 1 / (1 + F.exp(-logit))
    return F.when(score >= least, weight * score).otherwise(0.0)


def best_span(start: Column, end: Column, most: int = 30) -> Column:
    """struct(score, first, last, confidence): the span with the highest sum of start and end logits, `most` tokens beyond its first at most; the first of equals."""
    places = F.sequence(F.lit(1), F.size(start))
    reach = lambda s: F.slice(end, s, F.lit(most + 1))
    spans = F.transform(places, lambda s: F.struct((F.element_at(start, s) + F.array_max(reach(s))).alias("score"), (-s).alias("s")))
    best = F.array_max(spans)
    first = -best["s"]
    last = first - 1 + F.array_position(reach(first), F.array_max(reach(first))).cast("int")
    return F.struct(best["score"].alias("score"), (first - 1).alias("first"), (last - 1).alias("last"), (1 / (1 + F.exp(-best["score"] / 6))).alias("confidence"))


def sentence_around(text: str, relative: float, most: int = 240) -> str:
    """The sentence of a text at a place from 0 to 1."""
    center = int(min(1.0, max(0.0, relative)) * max(0, len(text) - 1))
    start = max(text.rfind(x, 0, center) for x in (". ", "! ", "? ", "\n"))
    start = start + 1 if start >= 0 else 0
    ends = [e for e in (text.find(x, center) for x in (". ", "! ", "? ", "\n")) if e >= 0]
    return text[start : min(ends) + 1 if ends else len(text)].strip()[:most]
