"""Learning to rank: attribution of clicks, samples, an online logistic ranker and its gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovesift.config import DEFAULTS, Settings

#: How much a click is worth by what ties it to the exposure.
TIERS = (1.0, 0.85, 0.7)
FEATURES = 13


def attribute(exposures: DataFrame, clicks: DataFrame, before: int = 30, after: int = 1) -> DataFrame:
    """(click_id, exposure_id, tier, confidence): exposures of the same item in an interval around the click, of its best tier only.

    exposures (exposure_id, item_id, created_at, context, digest, query), clicks (click_id,
    item_id, ts, context, digest, query), times in seconds. The interval is bucketed, so the
    range join is an equi-join on item and bucket, not a nested loop.
    """
    width = before + after + 1
    e = exposures.withColumn("_b", F.explode(F.array(F.floor(F.col("created_at") / width), F.floor(F.col("created_at") / width) + 1)))
    c = clicks.withColumn("_b", F.floor((F.col("ts") + after) / width))
    pairs = c.alias("c").join(e.alias("e"), ["item_id", "_b"]).where("e.created_at between c.ts - {} and c.ts + {}".format(before, after))
    tier = F.when(F.col("e.context") == F.col("c.context"), 0).when((F.col("e.digest") == F.col("c.digest")) & (F.col("e.query") == F.col("c.query")), 1).when(F.col("e.query") == F.col("c.query"), 2)
    tied = pairs.select("click_id", "exposure_id", tier.alias("tier")).where("tier is not null")
    best = tied.withColumn("_best", F.min("tier").over(Window.partitionBy("click_id"))).where("tier = _best")
    return best.select("click_id", "exposure_id", "tier", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("confidence"))


def latest_context(events: DataFrame, key: str, value: Column, order: Column) -> DataFrame:
    """Each event with the last known value before it, itself included (as-of)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("context", F.last(value, ignorenulls=True).over(w))


def exposure_weight(rank: Column) -> Column:
    """Inverse propensity of a rank, from 1 to 4."""
    return F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.log2(rank + 2.0)))


def personal_weights(top3: float, interactions: int, s: Settings = DEFAULTS) -> dict[str, float] | None:
    """Weights of the personal linear model from the share of picks among the first three and the number of interactions; None if these are too few."""
    if interactions < max(s.ltr_min_interactions, 1):
        return None
    top3, scale = min(1.0, max(0.0, top3)), min(1.0, interactions / 2000)
    return {
        "bias": -2.2 + 0.4 * top3, "semantic": 1.6 + 1.4 * top3, "cross": 1.8 + 1.6 * top3, "feedback": 0.8 + 1.2 * scale, "router": 0.8 + 0.8 * top3,
        "need": 1.2 + 0.8 * top3, "exact": 0.9, "path_code": -1.0,
    }


def personal_delta(weights: dict[str, float] | None, semantic: Column, cross: Column, feedback: Column, frequency: Column, kind: Column, router: float, need: float, path_or_code: bool) -> Column:
    """What the personal model adds to a score, 8 at most either way; boosts count as shares of 40."""
    if weights is None:
        return F.lit(0.0)
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    fixed = weights["bias"] + weights["router"] * min(1.0, max(0.0, router)) + weights["need"] * min(1.0, max(0.0, need))
    total = fixed + weights["semantic"] * unit(semantic) + weights["cross"] * unit(cross) + weights["feedback"] * unit((feedback + frequency) / 40.0)
    total = total + F.when(kind.isin("exact_name", "prefix_name"), weights["exact"]).otherwise(0.0)
    if path_or_code:
        total = total + F.when(unit(semantic) > 0.7, weights["path_code"]).otherwise(0.0)
    return F.least(F.lit(8.0), F.greatest(F.lit(-8.0), total))


def linear(features: Column, weights: list[float], bias: float) -> Column:
    w = F.array(*(F.lit(float(x)) for x in weights))
    z = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(float(bias)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-z))


def rank_boost(probability: Column, blend: float) -> Column:
    return 24 * blend * (probability - 0.5)


def log_loss(probability: Column, label: Column, weight: Column) -> Column:
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), probability))
    return F.sum(-weight * F.when(label == 1, F.log(p)).otherwise(F.log(1 - p))) / F.sum(weight)


def split_holdout(samples: DataFrame, key: str, every: int = 5) -> DataFrame:
    """is_holdout: one row in `every` by the key's digest, the same in every task and batch."""
    return samples.withColumn("is_holdout", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % every == 0)


def sample_batch(examples: DataFrame, most: int, ratio: float = 3.0, seed: int = 1) -> DataFrame:
    """All positives up to `most`, then negatives up to `ratio` for each, in a seeded order."""
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "sample_id"), "sample_id")
    ranked = examples.where("label in (0, 1)").withColumn("_r", F.row_number().over(order))
    positives = min(most, examples.where("label = 1").count())
    negatives = min(int(np.ceil(ratio * positives)), most - positives)
    return ranked.where(((F.col("label") == 1) & (F.col("_r") <= positives)) | ((F.col("label") == 0) & (F.col("_r") <= negatives))).drop("_r")


def reservoir(rows: DataFrame, key: str, capacity: int, seed: int = 1) -> DataFrame:
    """A uniform sample that merges: the rows with the smallest seeded hashes. A top-k, so tasks keep `capacity` rows each."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(capacity)


def train(samples: DataFrame, weights: list[float], bias: float, s: Settings = DEFAULTS) -> DataFrame:
    """(weights, bias) after sequential gradient steps over a bounded batch (sample_id, features, label, weight) in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample_id")
        w, b = np.array(weights, float), float(bias)
        for _ in range(s.epochs):
            for x, y, weight in zip(rows.features, rows.label, rows.weight, strict=True):
                x = np.array(x)
                g = (1 / (1 + np.exp(-(w @ x + b))) - y) * max(0.05, weight)
                w -= s.learning_rate * (g * x + s.l2 * w)
                b -= s.learning_rate * g
        return pd.DataFrame({"weights": [w.tolist()], "bias": [b]})

    return samples.groupBy(F.lit("batch")).applyInPandas(lambda rows: run(rows), "weights array<double>, bias double")


def features(hit: dict[str, Column], kind: Column, router: Column, need: Column, rank: Column, tokens: Column, focused: Column) -> Column:
    """The 13 features of a shown hit: its signals (semantic, cross, feedback, frequency, context, score), the query's class, router and need, its rank and length."""
    between = lambda x, low, high: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x.cast("double")))
    is_ = lambda name: (kind == name).cast("double")
    return F.array(
        between(hit["semantic"], 0, 1), between(hit["cross"], 0, 1), between(hit["feedback"] / 25, 0, 2), between(hit["frequency"] / 30, 0, 2),
        between(hit["context"] / 25, -2, 2) + F.when(focused, 0.1).otherwise(0.0), between(need, 0, 1), between(router, 0, 1),
        is_("path_or_code"), is_("natural_language"), is_("short_ambiguous"), 1.0 / F.greatest(F.lit(1), rank + 1), between(tokens / 8, 0, 2), F.tanh(hit["score"] / 300),
    )


def exposures(shown: DataFrame, now: Column, most: int = 20) -> DataFrame:
    """Rows to log for shown results (query, item_id, rank from 0, features, context, digest): the first `most` of each query, unlabelled, weighted by inverse propensity."""
    top = shown.where(F.col("rank") < most)
    return top.select(
        F.sha2(F.concat_ws("|", "query", F.col("item_id").cast("string"), F.col("rank").cast("string"), now.cast("string")), 256).alias("exposure_id"),
        "query", "item_id", "rank", "features", "context", "digest", now.alias("created_at"), F.lit(None).cast("int").alias("label"),
        exposure_weight(F.col("rank") + 1).alias("weight"), F.lit(False).alias("consumed"),
    )


def training_mix(fresh: DataFrame, replay: DataFrame, most: int, share: float = 0.5) -> DataFrame:
    """Fresh examples and, up to `share` of `most` beside them, replayed ones that aren't among them; both the first by a seeded hash. `origin` tells which."""
    top = lambda df, n: df.orderBy(F.xxhash64(F.lit("mix"), "sample_id"), "sample_id").limit(n)
    kept = int(most * share)
    again = top(replay.join(fresh.select("sample_id"), "sample_id", "left_anti"), kept).withColumn("origin", F.lit("replay"))
    return top(fresh, most - kept).withColumn("origin", F.lit("fresh")).unionByName(again)


def measures(scored: DataFrame) -> DataFrame:
    """(n, positives, loss, failures, saturation) of rows (label, weight, p): shares of predictions that aren't numbers, and that are all but certain."""
    odd = F.col("p").isNull() | F.isnan("p")
    sound = F.when(odd, 0.5).otherwise(F.col("p"))
    return scored.withColumn("q", sound).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"), log_loss(F.col("q"), F.col("label"), F.col("weight")).alias("loss"),
        (F.count_if(odd) / F.count("*")).alias("failures"), (F.count_if((F.col("q") < 0.01) | (F.col("q") > 0.99)) / F.count("*")).alias("saturation"),
    )


def promote(active: dict, candidate: dict, examples: int, positives: int, least: int = 20, latency_ms: float = 0.0, most_latency_ms: float = 35.0, most_regression: float = 0.0) -> str | None:
    """None if the candidate takes over, else the reason why not; measures: loss, failures, saturation."""
    if examples < max(20, least):
        return "too_few_examples"
    if positives < 12:
        return "too_few_positives"
    if not np.isfinite(candidate["loss"]):
        return "invalid_loss"
    if latency_ms > most_latency_ms:
        return "latency"
    if candidate["loss"] > active["loss"] + most_regression:
        return "regression"
    if candidate.get("failures", 0) > 0.05:
        return "failure_rate"
    if candidate.get("saturation", 0) > 0.98:
        return "saturated"
    return None if candidate["loss"] + 0.002 < active["loss"] else "no_improvement"


def attribution_gate(positives: int, attributed: float, tied: float, least: int = 80) -> str | None:
    """Why positives can't be trusted yet: too few, too few attributed to an exposure, or too few by context and digest."""
    if positives < least:
        return "too_few_positives"
    if attributed < 0.5:
        return "attribution_rate"
    return "context_digest_rate" if tied < 0.1 else None


def cycle(examples: DataFrame, replay: DataFrame, weights: list[float], bias: float, now: Column, consent: bool, least: int = 60, most: int = 1200, s: Settings = DEFAULTS) -> dict:
    """One learning cycle: consent, fresh examples, a mix with replayed ones, a balanced batch, training, the holdout's gate.

    examples (sample_id, features, label, weight, created_at, consumed), replay (sample_id,
    features, label, weight). Gives the verdict, the weights to use from now on, the sample_ids
    that are consumed, and the next reservoir. Only batches bounded by `most` are gathered.
    """
    out = {"promoted": False, "weights": weights, "bias": bias, "consumed": None, "reservoir": replay}
    if not consent:
        return out | {"reason": "no_consent"}
    columns = ["sample_id", "features", "label", "weight"]
    mixed = training_mix(fresh_examples(examples, now).select(*columns), replay.select(*columns), most)
    batch = sample_batch(mixed, most).select(*columns)
    if batch.count() < least:
        return out | {"reason": "too_few_samples"}
    split = split_holdout(batch, "sample_id")
    trained = train(split.where("not is_holdout"), weights, bias, s).first()
    held = split.where("is_holdout")
    measured = [measures(held.withColumn("p", linear(F.col("features"), list(w), b))).first().asDict() for w, b in ((weights, bias), (trained.weights, trained.bias))]
    counts = batch.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives")).first()
    reason = promote(*measured, counts.n, counts.positives)
    out |= {"reason": reason or "promoted", "active": measured[0], "candidate": measured[1], "consumed": batch.select("sample_id"), "reservoir": reservoir(replay.select(*columns).unionByName(batch), "sample_id", 512)}
    if reason is None:
        out |= {"promoted": True, "weights": list(trained.weights), "bias": float(trained.bias)}
    return out


def admit_events(events: DataFrame, consent: bool, types: list[str], denied: list[str], keep_hashes: bool = True, hashes: tuple[str, ...] = ()) -> DataFrame:
    """Behaviour events that may be kept: consent, captured types, no denied app, no privacy flag. Columns `hashes` are blanked unless they may be kept."""
    rule = F.lit(consent) & F.col("event_type").isin(*types) & ~F.coalesce(F.col("app").isin(*denied), F.lit(False)) & ~F.coalesce(F.col("private"), F.lit(False))
    kept = events.where(rule)
    return kept if keep_hashes or not hashes else kept.withColumns({c: F.lit(None).cast(kept.schema[c].dataType) for c in hashes})


def fresh_examples(examples: DataFrame, now: Column, stale: int = 30) -> DataFrame:
    """Unconsumed examples with a label, or without one for `stale` seconds (these count as negative)."""
    old = F.col("created_at") <= F.unix_timestamp(now) - stale
    return examples.where(~F.col("consumed") & (F.col("label").isin(0, 1) | (F.col("label").isNull() & old))).withColumn("label", F.coalesce("label", F.lit(0)))
