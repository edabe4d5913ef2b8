"""Incremental indexing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.functions import text
from trovesift.operators import indexing as X
from trovesift.operators import merge
from trovesift.plans.relations import CONTENT, FAILURES, ITEMS, content, failures, items, table, with_


@query()
def chunks(spark, sf_dir):
    """Chunks of cleaned texts; tests hold their concatenation against the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.inline(text.chunks(text.clean(F.col("text")))))
    return docs.select("doc_id", "chunk_index", "byte_offset", F.md5("chunk_text").alias("chunk_md5"), F.length("chunk_text").alias("n_chars"))


@query()
def first_passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.inline(text.chunks(text.clean(F.col("text")))))
    return X.first_passages(docs).select("item_id", "ordinal", F.md5("chunk_text").alias("chunk_md5"))


@query("""WITH ev AS (SELECT 'p' || user_id || '/' || (epoch_us(ts) // 3600000000) AS path, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS r FROM events)
SELECT path, CASE min(r) WHEN 1 THEN 'delete' WHEN 2 THEN 'modified' WHEN 3 THEN 'new' ELSE 'rescan' END AS kind, count(*) AS n_events FROM ev GROUP BY path""")
def coalesce_events(spark, sf_dir):
    """All events; a path for each user and hour."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "modified").when(F.col("event_type") == "view", "new").otherwise("rescan")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), "user_id", F.lit("/"), hour).alias("path"), kind.alias("kind"), F.col("event_id").alias("seq"))
    return X.coalesce_changes(e)


@query("SELECT event_id, event_id < max(event_id) OVER (PARTITION BY user_id) AS stale FROM events")
def generation_staleness(spark, sf_dir):
    w = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("generation"), "event_id")
    return X.latest_generation(w).select("event_id", "stale")


@query(with_(ITEMS) + """SELECT path, CASE WHEN item_id % 10 = 0 THEN 'deleted' WHEN item_id % 10 = 1 THEN 'new' WHEN item_id % 10 = 2 THEN 'modified' ELSE 'skipped' END AS status FROM items""")
def change_detect(spark, sf_dir):
    i = items(spark, sf_dir).select("item_id", "path", "size", F.unix_timestamp("modified_at").alias("mtime"), F.md5("path").alias("hash"))
    old, k = i.where("item_id % 10 <> 1").drop("item_id"), F.col("item_id") % 10
    new = i.where("item_id % 10 <> 0").select("path", F.when(k == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k == 3, F.col("mtime") + 5).otherwise(F.col("mtime")).alias("mtime"), F.when(k == 2, F.lit("x")).otherwise(F.col("hash")).alias("hash"))
    return X.detect_changes(old, new)


@query(with_(ITEMS) + """SELECT path, CASE WHEN item_id % 4 = 0 THEN size + 100 ELSE size END AS size, CASE WHEN item_id % 4 = 0 THEN 2 ELSE 1 END AS indexed_at, item_id % 97 = 0 AS is_pinned FROM items
UNION ALL SELECT '/new/' || item_id, size, 2, FALSE FROM items WHERE item_id % 50 = 0""")
def upsert_items(spark, sf_dir):
    """Changed rows replace old ones by path, but a pin stays."""
    i = items(spark, sf_dir)
    state = i.select("path", "size", F.lit(1).alias("indexed_at"), "is_pinned")
    changed = i.where("item_id % 4 = 0").select("path", (F.col("size") + 100).alias("size"), F.lit(2).alias("indexed_at"), F.lit(False).alias("is_pinned"))
    added = i.where("item_id % 50 = 0").select(F.concat(F.lit("/new/"), "item_id").alias("path"), "size", F.lit(2).alias("indexed_at"), F.lit(False).alias("is_pinned"))
    return merge.upsert(state, changed.unionByName(added), "path", keep=("is_pinned",))


@query(with_(ITEMS, CONTENT) + "SELECT 'items' AS t, count(*) AS n FROM items WHERE item_id % 9 <> 0 UNION ALL SELECT 'content', count(*) FROM content WHERE item_id % 9 <> 0")
def delete_cascade(spark, sf_dir):
    i, c = items(spark, sf_dir), content(spark, sf_dir)
    left = merge.delete_cascade({"items": i, "content": c}, i.where("item_id % 9 = 0"))
    return left["items"].agg(F.lit("items").alias("t"), F.count("*").alias("n")).unionByName(left["content"].agg(F.lit("content").alias("t"), F.count("*").alias("n")))


@query("""SELECT user_id AS item_id, event_type AS stage, count(*) AS failure_count, min(epoch_us(ts) // 1000000) AS first_at, max(epoch_us(ts) // 1000000) AS last_at,
  arg_max(props, (epoch_us(ts) // 1000000, props)) AS message FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id, event_type""")
def failure_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    return X.record_failures(e.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("stage"), F.col("props").alias("message"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")))


@query(with_(FAILURES) + """SELECT item_id, item_id % 5 AS attempt, least(8000, CAST(500 * pow(4, item_id % 5) AS INT)) AS delay_ms FROM failures WHERE error_message IN ('Timeout', 'Unknown error') AND item_id % 5 < 3""")
def retry_schedule(spark, sf_dir):
    f = failures(spark, sf_dir).withColumn("attempt", F.col("item_id") % 5)
    return X.retry_schedule(f).select("item_id", "attempt", "delay_ms")


@query(with_(ITEMS, CONTENT) + "SELECT item_id, length(chunk_text) AS n FROM content JOIN items USING (item_id) WHERE path = '/home/u/Desktop' OR path.starts_with('/home/u/Desktop/')")
def rebuild_scope(spark, sf_dir):
    from trovesift.functions.paths import under

    scope = items(spark, sf_dir).where(under(F.col("path"), "/home/u/Desktop/")).select("item_id")
    return content(spark, sf_dir).join(scope, "item_id").select("item_id", F.length("chunk_text").cast("long").alias("n"))
