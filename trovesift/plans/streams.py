"""Streaming queries, run over all that is there; the oracles are the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.plans.relations import table
from trovesift.sources.scratch import shared_folder
from trovesift.streaming import attribution, coordinator
from trovesift.streaming import pipelines as P


def _events(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = P.stream_table(spark, f"{sf_dir}/events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _to_millis(at):
    """The nearest millisecond of a time, as `epoch_ms` of the SQL has it: the streams with state by key count in these."""
    return F.timestamp_millis(F.round(F.unix_micros(at).cast("decimal(20, 0)") / 1000).cast("long"))


@query("SELECT event_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    """Events that arrive twice are kept once."""
    e = _events(spark, sf_dir)
    twice = e.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    out = shared_folder(spark, "dedupe")
    P.run_now(P.dedupe(twice).select("event_id", "event_type"), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_activity(spark, sf_dir):
    """In update mode each batch writes the windows it touched; the last state of each window counts."""
    out = shared_folder(spark, "activity")
    P.run_batches(P.activity(_events(spark, sf_dir)), f"{out}/data", f"{out}/checkpoint")
    rows = spark.read.parquet(f"{out}/data")
    last = rows.groupBy(F.unix_timestamp("window.start").alias("start"), "event_type").agg(F.max_by(F.struct("n", "total"), F.col("batch")).alias("s"))
    return last.select("start", "event_type", "s.n", F.round("s.total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_activity(spark, sf_dir):
    """Sessions by a gap of half an hour; beyond the reference, as a batch over the same transformation."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return P.sessions(e).select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n")


@query("""SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_action,
  substr(sha256(event_type || '|' || user_id || '|' || event_id), 1, 32) AS digest FROM events""")
def forward_fill_context(spark, sf_dir):
    from trovesift.operators.learning import latest_context

    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    filled = latest_context(e, "user_id", action, F.struct("ts", "event_id"))
    return filled.select("event_id", F.col("context").alias("last_action"), F.substring(F.sha2(F.concat_ws("|", "event_type", "user_id", "event_id"), 256), 1, 32).alias("digest"))


_KINDS = {"signup": "new", "view": "modified", "click": "modified", "error": "delete", "purchase": "done"}


@query(f"""WITH RECURSIVE e AS (SELECT 'u' || user_id AS path, epoch_ms(ts) AS ms, event_type <> 'purchase' AS change,
  CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 2 ELSE 1 END AS rank FROM events),
mark AS (SELECT max(ms) - 3600000 AS w FROM e),
gaps AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY path ORDER BY ms) < 1800000 THEN 0 ELSE 1 END AS first FROM e WHERE change),
runs AS (SELECT *, sum(first) OVER (PARTITION BY path ORDER BY ms ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
steps AS (SELECT path, t, o, rank, n, row_number() OVER (PARTITION BY path ORDER BY t, o) AS i, sum(1 - o) OVER (PARTITION BY path ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS generation FROM (
  SELECT path, max(ms) + 1800000 AS t, 0 AS o, min(rank) AS rank, count(*) AS n FROM runs, mark GROUP BY path, run, w HAVING max(ms) + 1800000 <= w
  UNION ALL SELECT path, ms, 1, NULL, NULL FROM e, mark WHERE NOT change AND ms < w)),
walk AS (
  SELECT DISTINCT path, CAST(0 AS BIGINT) AS i, FALSE AS flying, CAST(NULL AS INTEGER) AS pending, CAST(0 AS BIGINT) AS waiting, CAST(NULL AS INTEGER) AS rank, CAST(0 AS BIGINT) AS n FROM steps
  UNION ALL SELECT s.path, s.i, CASE WHEN s.o = 0 THEN TRUE ELSE w.flying AND w.pending IS NOT NULL END,
    CASE WHEN s.o = 0 AND w.flying THEN least(coalesce(w.pending, s.rank), s.rank) END, CASE WHEN s.o = 0 AND w.flying THEN w.waiting + s.n ELSE 0 END,
    CASE WHEN s.o = 0 AND NOT w.flying THEN s.rank WHEN s.o = 1 AND w.flying THEN w.pending END, CASE WHEN s.o = 0 THEN s.n ELSE w.waiting END
  FROM walk w JOIN steps s ON s.path = w.path AND s.i = w.i + 1)
SELECT s.path, CAST(s.generation AS INTEGER) AS generation, ['delete', 'modified', 'new'][w.rank + 1] AS kind, s.t AS due_ms, CAST(w.n AS INTEGER) AS changes
FROM walk w JOIN steps s ON s.path = w.path AND s.i = w.i WHERE w.rank IS NOT NULL""")
def path_dispatches(spark, sf_dir):
    """A user's events as changes of a path, purchases as completions: bursts by half an hour, one dispatch in flight."""
    kind = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))[F.col("event_type")]
    events = _events(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("path"), kind.alias("kind"), _to_millis(F.col("ts")).alias("at"))
    out = shared_folder(spark, "dispatches")
    with P.keyed_state(spark):
        P.run_now(coordinator.dispatches(events, late="1 hour", quiet_ms=1_800_000), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").select("path", "generation", "kind", F.unix_millis("due").alias("due_ms"), "changes")


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k, epoch_ms(ts) AS ms, event_id % 20 AS item_id FROM events),
mark AS (SELECT max(ms) - 3600000 AS w FROM e WHERE event_type IN ('view', 'click')),
pairs AS (SELECT c.event_id AS click_id, x.event_id AS e, CASE WHEN x.user_id = c.user_id THEN 0 WHEN x.k = c.k THEN 1 ELSE 2 END AS t
  FROM e c JOIN e x ON c.event_type = 'click' AND x.event_type = 'view' AND x.item_id = c.item_id AND x.ms BETWEEN c.ms - 7200000 AND c.ms + 60000
  WHERE x.user_id = c.user_id OR x.user_id % 5 = c.user_id % 5),
clicks AS (SELECT c.item_id, c.event_id, c.ms, row_number() OVER (PARTITION BY c.item_id ORDER BY c.ms, c.event_id) AS i, coalesce(p.l, []) AS l FROM e c CROSS JOIN mark
  LEFT JOIN (SELECT click_id, list(struct_pack(e := e, t := t)) AS l FROM pairs GROUP BY click_id) p ON p.click_id = c.event_id WHERE c.event_type = 'click' AND c.ms + 60000 < w),
walk AS (
  SELECT DISTINCT item_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS got, CAST(NULL AS INTEGER) AS tier FROM clicks
  UNION ALL SELECT item_id, i, list_concat(taken, got), got, tier FROM (
    SELECT item_id, i, taken, list_transform(list_filter(free, lambda x: x.t = list_min(list_transform(free, lambda y: y.t))), lambda x: x.e) AS got, list_min(list_transform(free, lambda x: x.t)) AS tier FROM (
      SELECT c.item_id, c.i, w.taken, list_filter(c.l, lambda x: NOT list_contains(w.taken, x.e)) AS free FROM walk w JOIN clicks c ON c.item_id = w.item_id AND c.i = w.i + 1)))
SELECT w.item_id, c.event_id AS click_id, exposure_id, tier, CASE WHEN tier IS NULL THEN 1.0 ELSE [1.0, 0.85, 0.7][tier + 1] END::DOUBLE AS confidence, c.ms AS at_ms
FROM (SELECT item_id, i, tier, unnest(CASE WHEN len(got) = 0 THEN [NULL] ELSE got END) AS exposure_id FROM walk WHERE i > 0) w JOIN clicks c ON c.item_id = w.item_id AND c.i = w.i""")
def stream_attribution(spark, sf_dir):
    """Views are exposures, clicks are clicks; each view is taken once, and a click without one is a positive of its own."""
    events = _events(spark, sf_dir).where("event_type in ('view', 'click')").select(
        F.when(F.col("event_type") == "click", "click").otherwise("exposure").alias("side"), "event_id", (F.col("event_id") % 20).alias("item_id"), _to_millis(F.col("ts")).alias("at"),
        F.col("user_id").cast("string").alias("context"), F.get_json_object("props", "$.k").alias("digest"), (F.col("user_id") % 5).cast("string").alias("query"),
    )
    out = shared_folder(spark, "attribution")
    with P.keyed_state(spark):
        P.run_now(attribution.attribute_stream(events, 7_200_000, 60_000, "1 hour"), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").select("item_id", "click_id", "exposure_id", "tier", "confidence", F.unix_millis("at").alias("at_ms"))
