"""Feedback statistics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.operators import feedback as B
from trovesift.plans.relations import FEEDBACK, ITEMS, as_of, feedback, items, with_


def _opens(spark, sf_dir):
    return feedback(spark, sf_dir).where("action = 'open'").join(items(spark, sf_dir).select("item_id", "path", "extension"), "item_id")


@query(with_(ITEMS, FEEDBACK) + """SELECT regexp_extract(path, '^(.*)/', 1) AS directory, count(*) AS count, least(count(*) / 5.0, 15.0) AS boost FROM feedback JOIN items USING (item_id)
WHERE action = 'open' AND timestamp >= TIMESTAMP '2023-11-02' GROUP BY 1 ORDER BY count DESC, directory LIMIT 50""")
def path_preferences(spark, sf_dir):
    return B.path_preferences(_opens(spark, sf_dir), as_of())


@query(with_(ITEMS, FEEDBACK) + """, c AS (SELECT CASE WHEN extension = 'py' THEN 'code' WHEN extension = 'png' THEN 'media' ELSE 'document' END AS category, count(*) AS count
  FROM feedback JOIN items USING (item_id) WHERE action = 'open' AND timestamp >= TIMESTAMP '2024-01-01' GROUP BY 1)
SELECT category, count, round(count / (SELECT sum(count) FROM c), 6) AS share, count / (SELECT sum(count) FROM c) > 0.6 AS is_majority FROM c""")
def type_affinity(spark, sf_dir):
    return B.type_affinity(_opens(spark, sf_dir), as_of())


@query(with_(FEEDBACK) + "SELECT query, item_id, least(5 * count(*), 25) AS boost FROM feedback WHERE timestamp >= TIMESTAMP '2023-11-02' GROUP BY query, item_id")
def interaction_boost(spark, sf_dir):
    return B.interaction_boost(feedback(spark, sf_dir), as_of())


@query(with_(FEEDBACK) + """SELECT item_id, count(*) FILTER (WHERE action = 'open') AS open_count, epoch_us(max(timestamp) FILTER (WHERE action = 'open')) // 1000000 AS last_open, count(*) AS total FROM feedback GROUP BY item_id""")
def feedback_incremental(spark, sf_dir):
    """A state and a delta, merged: the same as one rollup over both."""
    f, cut = feedback(spark, sf_dir), F.lit("2024-01-20").cast("timestamp")
    merged = B.merge_rollup(B.rollup(f.where(F.col("timestamp") < cut)), B.rollup(f.where(F.col("timestamp") >= cut)))
    return merged.select("item_id", "open_count", F.unix_timestamp("last_open").alias("last_open"), "total")


@query(with_(FEEDBACK) + "SELECT action, count(*) AS n FROM feedback WHERE timestamp >= TIMESTAMP '2024-01-21' GROUP BY action")
def retention_prune(spark, sf_dir):
    return B.prune(feedback(spark, sf_dir), as_of(), 10).groupBy("action").agg(F.count("*").alias("n"))


@query(with_(FEEDBACK) + "SELECT event_id, action, query, item_id, epoch_us(timestamp) // 1000000 AS at FROM feedback")
def export_interactions(spark, sf_dir):
    """Rows as the exporter of trovesift.sources.exports writes them, newest first there."""
    return feedback(spark, sf_dir).select("event_id", "action", "query", "item_id", F.unix_timestamp("timestamp").alias("at"))
