"""Upkeep of the catalog: order of work, lanes, single paths, rebuilds, migrations, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.operators import health as H
from trovesift.operators import indexing as X
from trovesift.plans.relations import CONTENT, FAILURES, ITEMS, content, failures, items, table, with_
from trovesift.sources import stores
from trovesift.streaming.pipelines import classify

_KIND = "CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END"


def _work(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "modified").when(F.col("event_type") == "view", "new").otherwise("rescan")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("p"), "user_id").alias("path"), kind.alias("kind"), F.col("event_id").alias("seq"))


@query(f"""WITH w AS (SELECT 'p' || user_id AS path, event_id AS seq, {_KIND} AS priority FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY priority = 4, seq, path) AS n, count(*) FILTER (WHERE priority < 4) OVER () AS must FROM w)
SELECT path, seq, priority FROM r WHERE priority < 4 OR n <= must + greatest(0, 1000 - must)""")
def work_order(spark, sf_dir):
    """Under pressure only rescans are dropped."""
    return X.work_order(_work(spark, sf_dir), 1000).select("path", "seq", "priority")


@query("""WITH w AS (SELECT 'p' || user_id AS path, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'rebuild' ELSE 'live' END AS lane FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY seq, path) - 1 AS n FROM w)
SELECT path, seq, lane, CASE lane WHEN 'live' THEN n // 70 * 100 + n % 70 ELSE n // 30 * 100 + n % 30 + 70 END AS slot FROM r WHERE n < CASE lane WHEN 'live' THEN 4000 ELSE 20000 END""")
def work_lanes(spark, sf_dir):
    w = _work(spark, sf_dir).select("path", "seq", F.when(F.col("seq") % 3 == 0, "rebuild").otherwise("live").alias("lane"))
    return X.lanes(w).select("path", "seq", "lane", "slot")


@query(with_(ITEMS) + "SELECT path, CASE WHEN item_id = 7 THEN size + 1 ELSE size END AS size FROM items")
def reindex_path(spark, sf_dir):
    i = items(spark, sf_dir).select("item_id", "path", "size")
    path = i.where("item_id = 7").first().path
    return X.reindex(i.select("path", "size"), i.select("path", (F.col("size") + 1).alias("size")), path)


@query(with_(ITEMS) + "SELECT path, size FROM items WHERE path LIKE '/home/u/Documents/%' OR path LIKE '/home/u/Downloads/%'")
def rebuild_catalog(spark, sf_dir):
    i = items(spark, sf_dir).select("path", "size", F.unix_timestamp("modified_at").alias("mtime"), F.md5("path").alias("hash"))
    older = i.withColumn("mtime", F.col("mtime") - 1).withColumn("size", F.col("size") + 5)
    return X.rebuild(i.unionByName(older), ["/home/u/Documents", "/home/u/Downloads"]).select("path", "size")


@query(with_(ITEMS) + "SELECT path, CASE WHEN item_id % 3 = 0 THEN md5(path || '!') ELSE md5(path) END AS hash, size FROM items")
def hash_update(spark, sf_dir):
    i = items(spark, sf_dir)
    state = i.select("path", F.md5("path").alias("hash"), "size")
    return X.update_hashes(state, i.where("item_id % 3 = 0").select("path", F.md5(F.concat("path", F.lit("!"))).alias("hash")))


@query(with_(ITEMS) + "SELECT item_id, size, FALSE AS is_pinned, 'normal' AS sensitivity, CAST(NULL AS VARCHAR) AS content_hash, CAST(0 AS BIGINT) AS indexed_at FROM items")
def migrate_defaults(spark, sf_dir):
    return stores.migrate(items(spark, sf_dir).select("item_id", "size"), 1)[0]


@query("SELECT count(*) AS searches, count(*) FILTER (WHERE event_type = 'click') AS rewrites_applied, CAST(sum(event_id % 3) AS BIGINT) AS semantic_admitted, CAST(sum(event_id % 5) AS BIGINT) AS semantic_suppressed FROM events")
def query_counters(spark, sf_dir):
    log = table(spark, sf_dir, "events").select((F.col("event_type") == "click").alias("rewrite_applied"), (F.col("event_id") % 3).alias("admitted"), (F.col("event_id") % 5).alias("suppressed"))
    return H.query_counters(log)


@query(with_(ITEMS) + """SELECT path, CASE WHEN extension = 'png' THEN 'excluded' WHEN extension = 'pdf' THEN 'metadata_only' WHEN item_id % 10 = 0 THEN 'deleted' WHEN item_id % 11 = 3 THEN 'extraction_failed' ELSE 'skipped' END AS status
FROM items WHERE item_id % 10 <> 0 OR extension NOT IN ('png', 'pdf') UNION ALL SELECT path, 'deleted' FROM items WHERE item_id % 10 = 0 AND extension IN ('png', 'pdf')""")
def change_states(spark, sf_dir):
    """All states of a path: also excluded, kept as metadata only, and failed."""
    i = items(spark, sf_dir).select("item_id", "path", "size", "extension", F.unix_timestamp("modified_at").alias("mtime"), F.md5("path").alias("hash"))
    c = F.col
    return X.detect_changes(i.drop("item_id", "extension"), i.where("item_id % 10 <> 0"), c("s.extension") == "png", c("s.extension") == "pdf", c("s.item_id") % 11 == 3)


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_type = 'error' THEN 'delete' WHEN event_id % 5 = 0 THEN 'rescan' WHEN event_type = 'view' THEN 'new' WHEN event_type = 'click' THEN 'modified' WHEN event_type = 'signup' THEN 'new' ELSE 'rescan' END AS kind FROM events""")
def change_kinds(spark, sf_dir):
    """Kinds of changes from their flags."""
    e, t = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", classify(e % 7 != 0, t == "error", t == "view", t == "click", t == "signup", e % 5 == 0).alias("kind"))


@query(with_(ITEMS, CONTENT, FAILURES) + """SELECT 'indexer_unavailable' AS overall_status, round(100.0 * (SELECT count(*) FROM embeddings) / count(*), 6) AS semantic_coverage,
  (SELECT count(*) FROM (SELECT * FROM failures ORDER BY last_failed_at DESC, item_id LIMIT 25)) AS n_recent FROM items""")
def service_health(spark, sf_dir):
    f = failures(spark, sf_dir)
    counts = H.index_health(items(spark, sf_dir), content(spark, sf_dir), f)
    row = H.service_health(counts, table(spark, sf_dir, "embeddings").count(), indexer=False)
    return row.select("overall_status", "semantic_coverage").withColumn("n_recent", F.lit(H.recent_errors(f).count()).cast("long"))
