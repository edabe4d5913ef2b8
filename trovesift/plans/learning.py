"""Learning queries over the events table: views are exposures, clicks are clicks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.operators import learning as L
from trovesift.plans.relations import AS_OF, FEEDBACK, as_of, feedback, table, with_

_WEIGHTS = [0.4, -0.2, 0.1]


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "event_type", "user_id", "value", k.alias("k"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 20).alias("item_id"))


_E = """e AS (SELECT event_id, event_type, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000000 AS tm, event_id % 20 AS item_id FROM events)"""


@query(f"""WITH {_E}, pairs AS (SELECT c.event_id AS click_id, x.event_id AS exposure_id, CASE WHEN x.user_id = c.user_id THEN 0 WHEN x.k = c.k AND x.user_id % 5 = c.user_id % 5 THEN 1 WHEN x.user_id % 5 = c.user_id % 5 THEN 2 END AS tier
  FROM e c JOIN e x ON c.event_type = 'click' AND x.event_type = 'view' AND x.item_id = c.item_id AND x.tm BETWEEN c.tm - 7200 AND c.tm + 60),
best AS (SELECT *, min(tier) OVER (PARTITION BY click_id) AS b FROM pairs WHERE tier IS NOT NULL)
SELECT click_id, exposure_id, tier, [1.0, 0.85, 0.7][tier + 1]::DOUBLE AS confidence FROM best WHERE tier = b""")
def attribution_interval_join(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "event_type", "item_id", "at", F.col("user_id").alias("context"), F.col("k").alias("digest"), (F.col("user_id") % 5).alias("query"))
    exposures = e.where("event_type = 'view'").select(F.col("event_id").alias("exposure_id"), "item_id", F.col("at").alias("created_at"), "context", "digest", "query")
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "item_id", F.col("at").alias("ts"), "context", "digest", "query")
    return L.attribute(exposures, clicks, 7200, 60)


@query(f"""WITH {_E} SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) AS context FROM e""")
def asof_context(spark, sf_dir):
    e = _events(spark, sf_dir)
    return L.latest_context(e, "user_id", F.when(F.col("event_type") == "signup", F.col("k")), F.struct("at", "event_id")).select("event_id", "context")


@query(f"""WITH {_E} SELECT event_type, count(*) AS n, count(*) FILTER (WHERE k IS NOT NULL) AS with_k, count(*) FILTER (WHERE value > 50) AS high, round(avg(CASE WHEN k <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3 FROM e GROUP BY event_type""")
def attribution_metrics(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("k").isNotNull()).alias("with_k"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.avg(F.when(F.col("k") <= 3, 1.0).otherwise(0.0)), 6).alias("top3"))


@query(f"""WITH {_E}, r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM e WHERE event_type = 'view')
SELECT event_id, rank, round(least(4.0, greatest(1.0, log2(rank + 2.0))), 6) AS weight FROM r WHERE rank <= 20""")
def exposure_weight(spark, sf_dir):
    from trovesift.operators.merge import top_per_group

    ranked = top_per_group(_events(spark, sf_dir).where("event_type = 'view'"), "user_id", [F.desc("value"), F.asc("event_id")], 20)
    return ranked.select("event_id", "rank", F.round(L.exposure_weight(F.col("rank")), 6).alias("weight"))


@query(with_(FEEDBACK) + """, t AS (SELECT avg(CASE WHEN position <= 3 THEN 1.0 ELSE 0.0 END) AS r, least(1.0, count(*) / 2000.0) AS n FROM feedback),
x AS (SELECT event_id, least(1.0, greatest(0.0, value / 100)) AS s, least(1.0, (event_id % 11) / 10.0) AS c, least(1.0, ((event_id % 26) + (event_id % 31)) / 40.0) AS f, event_id % 7 = 0 AS e FROM feedback)
SELECT event_id, round(least(8.0, greatest(-8.0, -2.2 + 0.4 * r + (0.8 + 0.8 * r) * 0.88 + (1.2 + 0.8 * r) * 0.2 + (1.6 + 1.4 * r) * s + (1.8 + 1.6 * r) * c + (0.8 + 1.2 * n) * f
  + CASE WHEN e THEN 0.9 ELSE 0.0 END + CASE WHEN s > 0.7 THEN -1.0 ELSE 0.0 END)), 6) AS delta FROM x, t""")
def ltr_delta(spark, sf_dir):
    """The personal model's delta of hits, for a query that looks like code."""
    f, k = feedback(spark, sf_dir), F.col("event_id")
    t = f.agg(F.avg(F.when(F.col("position") <= 3, 1.0).otherwise(0.0)).alias("top3"), F.count("*").alias("n")).first()
    delta = L.personal_delta(
        L.personal_weights(t.top3 or 0.0, t.n), F.col("value") / 100, k % 11 / 10.0, (k % 26).cast("double"), (k % 31).cast("double"), F.when(k % 7 == 0, "exact_name").otherwise("content"), 0.88, 0.2, True
    )
    return f.select("event_id", F.round(delta, 6).alias("delta"))


def _samples(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type in ('click', 'view')")
    return e.select(F.col("event_id").alias("sample_id"), F.array(F.col("value") / 100, F.coalesce("k", F.lit(0)) / 10.0, F.lit(1.0)).alias("features"), (F.col("event_type") == "click").cast("int").alias("label"), F.lit(1.0).alias("weight"))


_S = """s AS (SELECT event_id AS sample_id, 0.4 * value / 100 - 0.2 * coalesce(k, 0) / 10.0 + 0.1 + 0.05 AS z, CAST(event_type = 'click' AS INT) AS label FROM e WHERE event_type IN ('click', 'view'))"""


@query(f"""WITH {_E}, {_S}, h AS (SELECT *, CAST('0x' || md5(CAST(sample_id AS VARCHAR))[1:8] AS BIGINT) % 5 = 0 AS is_holdout, 1 / (1 + exp(-z)) AS p FROM s)
SELECT is_holdout, count(*) AS n, round(avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS loss FROM h GROUP BY is_holdout""")
def holdout_logloss(spark, sf_dir):
    """Loss of a linear model, inside and outside the holdout."""
    s = L.split_holdout(_samples(spark, sf_dir), "sample_id").withColumn("p", L.linear(F.col("features"), _WEIGHTS, 0.05))
    return s.groupBy("is_holdout").agg(F.count("*").alias("n"), F.round(L.log_loss(F.col("p"), F.col("label"), F.col("weight")), 6).alias("loss"))


@query(f"WITH {_E}, {_S} SELECT sample_id, round(24 * 0.3 * (1 / (1 + exp(-z)) - 0.5), 6) AS boost FROM s")
def online_rank_boost(spark, sf_dir):
    return _samples(spark, sf_dir).select("sample_id", F.round(L.rank_boost(L.linear(F.col("features"), _WEIGHTS, 0.05), 0.3), 6).alias("boost"))


@query()
def reservoir(spark, sf_dir):
    return L.reservoir(_samples(spark, sf_dir).select("sample_id", "label"), "sample_id", 256)


@query()
def training_batch(spark, sf_dir):
    return L.sample_batch(_samples(spark, sf_dir), 1200).select("sample_id", "label")


@query()
def sgd_train(spark, sf_dir):
    """Order-dependent, so in one task, on a batch that the sampler bounds."""
    return L.train(L.sample_batch(_samples(spark, sf_dir), 1200), _WEIGHTS, 0.05)


@query(f"WITH {_E} SELECT event_id, event_type FROM e WHERE event_type IN ('click', 'view', 'purchase') AND user_id % 7 <> 3 AND value <= 95")
def behavior_admission(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("app", F.concat(F.lit("app"), F.col("user_id") % 7)).withColumn("private", F.col("value") > 95)
    return L.admit_events(e, True, ["click", "view", "purchase"], ["app3"]).select("event_id", "event_type")


@query(f"""WITH {_E}, x AS (SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 0 END AS label, tm, event_id % 3 = 0 AS consumed FROM e)
SELECT event_id, coalesce(label, 0) AS label FROM x WHERE NOT consumed AND (label IS NOT NULL OR tm <= epoch_us(TIMESTAMP '{AS_OF}') // 1000000 - 1000000)""")
def fresh_training(spark, sf_dir):
    label = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 0)
    e = _events(spark, sf_dir).select("event_id", label.alias("label"), F.col("at").alias("created_at"), (F.col("event_id") % 3 == 0).alias("consumed"))
    return L.fresh_examples(e, as_of(), 1_000_000).select("event_id", "label")


def _shown(spark, sf_dir):
    """Views as shown results: a rank within the user, and the 13 features."""
    from trovesift.operators.merge import top_per_group

    e = top_per_group(_events(spark, sf_dir).where("event_type = 'view'"), "user_id", [F.desc("value"), F.asc("event_id")], 25).withColumn("k", F.coalesce("k", F.lit(0)))
    i, v = F.col("event_id"), F.col("value")
    hit = {"semantic": v / 100, "cross": F.col("k") / 10.0, "feedback": i % 60, "frequency": i % 90, "context": i % 120 - 60, "score": v * 5}
    kind = F.when(i % 3 == 0, "path_or_code").when(i % 3 == 1, "natural_language").otherwise("short_ambiguous")
    features = L.features(hit, kind, F.lit(0.88), F.lit(0.68), F.col("rank") - 1, i % 20, i % 2 == 0)
    return e.select(F.col("event_id"), F.col("user_id").cast("string").alias("query"), "item_id", (F.col("rank") - 1).alias("rank"), features.alias("features"), F.lit("c").alias("context"), F.lit("d").alias("digest"))


_SHOWN = f"""{_E}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank FROM e WHERE event_type = 'view'),
f AS (SELECT event_id, user_id, item_id, rank, [least(1.0, greatest(0.0, value / 100)), least(1.0, coalesce(k, 0) / 10.0), least(2.0, (event_id % 60) / 25.0), least(2.0, (event_id % 90) / 30.0),
  least(2.0, greatest(-2.0, (event_id % 120 - 60) / 25.0)) + CASE WHEN event_id % 2 = 0 THEN 0.1 ELSE 0.0 END, 0.68, 0.88, CAST(event_id % 3 = 0 AS INT), CAST(event_id % 3 = 1 AS INT), CAST(event_id % 3 = 2 AS INT),
  1.0 / (rank + 1), least(2.0, (event_id % 20) / 8.0), (exp(2 * value * 5 / 300) - 1) / (exp(2 * value * 5 / 300) + 1)] AS x FROM v WHERE rank < 25)"""


@query(f"WITH {_SHOWN} SELECT event_id, " + ", ".join(f"round(x[{k + 1}], 6) AS f{k}" for k in range(13)) + " FROM f")
def feature_vector(spark, sf_dir):
    """The 13 features of shown hits."""
    return _shown(spark, sf_dir).select("event_id", *(F.round(F.col("features")[k].cast("double"), 6).alias(f"f{k}") for k in range(L.FEATURES)))


@query(f"WITH {_SHOWN} SELECT CAST(user_id AS VARCHAR) AS query, item_id, rank, round(least(4.0, greatest(1.0, log2(rank + 3.0))), 6) AS weight, round(list_sum(x), 6) AS total, TRUE AS unlabelled FROM f WHERE rank < 20")
def exposure_log(spark, sf_dir):
    logged = L.exposures(_shown(spark, sf_dir), as_of())
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return logged.select("query", "item_id", "rank", F.round("weight", 6).alias("weight"), F.round(total, 6).alias("total"), (F.col("label").isNull() & ~F.col("consumed")).alias("unlabelled"))


@query(f"""WITH {_E}, {_S}, h AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM s)
SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives, round(avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS loss, 0.0 AS failures,
  round(count(*) FILTER (WHERE p < 0.01 OR p > 0.99) / count(*), 6) AS saturation FROM h""")
def model_measures(spark, sf_dir):
    """Loss, and the shares that the gates look at."""
    s = _samples(spark, sf_dir).withColumn("p", L.linear(F.col("features"), _WEIGHTS, 0.05))
    return L.measures(s).select("n", "positives", F.round("loss", 6).alias("loss"), F.round("failures", 6).alias("failures"), F.round("saturation", 6).alias("saturation"))


@query()
def learning_cycle(spark, sf_dir):
    """One whole cycle, over batches that its caps bound; tests hold its steps."""
    examples = _samples(spark, sf_dir).select("sample_id", "features", "label", "weight", F.lit(0).alias("created_at"), F.lit(False).alias("consumed"))
    out = L.cycle(examples.where("sample_id % 2 = 0"), _samples(spark, sf_dir).where("sample_id % 2 = 1"), _WEIGHTS, 0.05, as_of(), True)
    return spark.createDataFrame([(out["reason"], out["promoted"], [float(w) for w in out["weights"]], out["consumed"].count(), out["reservoir"].count())], "reason string, promoted boolean, weights array<double>, consumed long, reservoir long")
