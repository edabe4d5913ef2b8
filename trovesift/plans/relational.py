"""Relational core: health, failures, joins, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.functions.paths import directory
from trovesift.operators import health, merge
from trovesift.plans.relations import CONTENT, FAILURES, FEEDBACK, ITEMS, content, failures, feedback, items, table, with_

_EXPECTED = """stage = 'extraction' AND (error_message LIKE 'PDF extraction unavailable (%' OR error_message LIKE 'OCR extraction unavailable (%'
  OR error_message LIKE 'Leptonica failed to read image%' OR error_message LIKE 'Extension % is not supported by extractor'
  OR error_message LIKE 'File size % exceeds configured limit %'
  OR error_message IN ('File does not exist or is not a regular file', 'File is not readable', 'Failed to load PDF document',
    'PDF is encrypted or password-protected', 'File appears to be a cloud placeholder (size reported but no content readable)'))"""


@query(with_(ITEMS, CONTENT, FAILURES) + f"""SELECT (SELECT count(*) FROM items) AS n_items, (SELECT count(*) FROM content) AS n_chunks,
  (SELECT count(*) FROM items) - (SELECT count(DISTINCT item_id) FROM content) AS n_without_content,
  (SELECT count(*) FROM failures) AS n_failures, (SELECT count(*) FROM failures WHERE {_EXPECTED}) AS n_expected,
  (SELECT count(*) FROM failures WHERE NOT ({_EXPECTED})) AS n_critical, (SELECT count(*) FROM failures WHERE NOT ({_EXPECTED})) = 0 AS healthy,
  CASE WHEN (SELECT count(*) FROM failures WHERE NOT ({_EXPECTED})) > 0 THEN 'critical_failures' ELSE 'healthy' END AS status,
  round(100.0 * (SELECT count(DISTINCT item_id) FROM content) / (SELECT count(*) FROM items), 6) AS content_coverage""")
def health_counts(spark, sf_dir):
    """Index health in one row: counts, status ladder and coverage."""
    return health.index_health(items(spark, sf_dir), content(spark, sf_dir), failures(spark, sf_dir))


@query(with_(ITEMS, CONTENT) + "SELECT item_id, path FROM items WHERE item_id NOT IN (SELECT item_id FROM content)")
def items_without_content(spark, sf_dir):
    return items(spark, sf_dir).join(content(spark, sf_dir), "item_id", "left_anti").select("item_id", "path")


@query(with_(ITEMS, FAILURES) + """SELECT f.item_id, path, error_message FROM failures f JOIN items i ON i.item_id = f.item_id
  ORDER BY last_failed_at DESC, f.item_id LIMIT 25 OFFSET 5""")
def failures_join_paged(spark, sf_dir):
    joined = failures(spark, sf_dir).join(items(spark, sf_dir).select("item_id", "path"), "item_id")
    return joined.orderBy(F.desc("last_failed_at"), "item_id").offset(5).limit(25).select("item_id", "path", "error_message")


@query(with_(FAILURES) + f"""SELECT error_message, {_EXPECTED} AS expected_gap, error_message IN ('Timeout', 'Unknown error') AS transient, count(*) AS n
  FROM failures GROUP BY ALL""")
def failure_split(spark, sf_dir):
    f = failures(spark, sf_dir)
    return f.groupBy("error_message", health.expected_gap(F.col("stage"), F.col("error_message")).alias("expected_gap"), health.transient(F.col("error_message")).alias("transient")).agg(F.count("*").alias("n"))


@query(with_(ITEMS, FEEDBACK) + """SELECT i.item_id, count(f.item_id) AS open_count, epoch_us(max(f.timestamp)) // 1000000 AS last_open
  FROM items i LEFT JOIN feedback f ON f.item_id = i.item_id AND f.action = 'open' GROUP BY i.item_id""")
def feedback_left_join_rollup(spark, sf_dir):
    opens = merge.open_counts(feedback(spark, sf_dir))
    joined = items(spark, sf_dir).select("item_id").join(opens, "item_id", "left")
    return joined.select("item_id", F.coalesce("open_count", F.lit(0)).alias("open_count"), F.unix_timestamp("last_open").alias("last_open"))


@query(with_(ITEMS, FEEDBACK) + """, f AS (SELECT item_id, count(*) AS open_count FROM feedback WHERE action = 'open' GROUP BY item_id)
SELECT i.item_id, coalesce(open_count, 0) AS open_count FROM items i LEFT JOIN f USING (item_id) WHERE i.item_id IN (1, 5, 7, 97, 194, 500, 999)""")
def frequencies_lookup(spark, sf_dir):
    wanted = items(spark, sf_dir).where(F.col("item_id").isin(1, 5, 7, 97, 194, 500, 999)).select("item_id")
    return wanted.join(merge.open_counts(feedback(spark, sf_dir)), "item_id", "left").select("item_id", F.coalesce("open_count", F.lit(0)).alias("open_count"))


@query(with_(ITEMS) + """, hits AS (
  SELECT item_id, 1 AS origin FROM items WHERE contains(path, '/src1') AND extension = 'md' UNION ALL
  SELECT item_id, 2 FROM items WHERE contains(path, '/src1') UNION ALL SELECT item_id, 4 FROM items WHERE contains(name, '7'))
SELECT item_id, bit_or(origin) AS origins FROM hits GROUP BY item_id""")
def candidate_union_origins(spark, sf_dir):
    i = items(spark, sf_dir)
    strict = i.where(F.col("path").contains("/src1") & (F.col("extension") == "md"))
    relaxed, by_name = i.where(F.col("path").contains("/src1")), i.where(F.col("name").contains("7"))
    return merge.union_origins([(strict, 1), (relaxed, 2), (by_name, 4)])


@query(with_(ITEMS) + """, hits AS (SELECT item_id, name FROM items WHERE extension = 'pdf' AND contains(path, '/Documents/'))
SELECT item_id, 'lexical' AS origin FROM hits UNION ALL
SELECT * FROM (SELECT item_id, 'name' FROM items WHERE contains(lower(name), '11') AND item_id NOT IN (SELECT item_id FROM hits) ORDER BY length(name), name, item_id LIMIT 6)""")
def name_fallback_union(spark, sf_dir):
    i = items(spark, sf_dir)
    hits = i.where((F.col("extension") == "pdf") & F.col("path").contains("/Documents/"))
    return merge.append_missing(hits, i.where(F.lower("name").contains("11")), 6)


@query(with_(FEEDBACK) + """SELECT item_id, action = 'pin' AS is_pinned FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY timestamp DESC, event_id DESC) AS r FROM feedback WHERE action IN ('pin', 'unpin')) WHERE r = 1""")
def latest_pin_state(spark, sf_dir):
    return merge.latest_pins(feedback(spark, sf_dir))


@query(with_(ITEMS) + """SELECT extension, item_id, size, r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY extension ORDER BY size DESC, item_id) AS r FROM items) WHERE r <= 10""")
def topk_per_group(spark, sf_dir):
    return merge.top_per_group(items(spark, sf_dir), "extension", [F.desc("size"), F.asc("item_id")], 10).select("extension", "item_id", "size", "rank")


@query(with_(ITEMS, CONTENT, FAILURES) + """SELECT i.item_id, CASE WHEN EXISTS (SELECT 1 FROM content c WHERE c.item_id = i.item_id) THEN 'available'
  WHEN (SELECT max(error_message) FROM failures f WHERE f.item_id = i.item_id) LIKE 'File appears to be a cloud placeholder%' THEN 'offline_placeholder'
  WHEN EXISTS (SELECT 1 FROM failures f WHERE f.item_id = i.item_id) THEN 'extract_failed' ELSE 'available' END AS availability FROM items i""")
def availability(spark, sf_dir):
    return health.availability(items(spark, sf_dir), content(spark, sf_dir), failures(spark, sf_dir)).select("item_id", "availability")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_lineitem(spark, sf_dir):
    """Not in the reference: subtotals over the star schema."""
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most
  FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("p50"),
        F.round(F.percentile("value", 0.95), 6).alias("p95"), F.max("value").alias("most"))


@query(with_(ITEMS) + "SELECT item_id, name, path FROM items WHERE size BETWEEN 500 AND 2000 AND modified_at >= TIMESTAMP '2024-01-01' ORDER BY size DESC, item_id LIMIT 20")
def filtered_topk(spark, sf_dir):
    i = items(spark, sf_dir).where(F.col("size").between(500, 2000) & (F.col("modified_at") >= F.lit("2024-01-01").cast("timestamp")))
    return i.orderBy(F.desc("size"), "item_id").limit(20).select("item_id", "name", "path")


@query(with_(ITEMS) + """SELECT item_id, CASE WHEN is_pinned THEN 'pinned' WHEN r <= 5 THEN 'recent' ELSE 'files' END AS section, r AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY extension, path_root ORDER BY modified_at DESC, item_id) AS r FROM (SELECT *, regexp_extract(path, '^(.*)/', 1) AS path_root FROM items))""")
def result_sections(spark, sf_dir):
    """Sections of result lists: one list for each kind of file in each folder."""
    order = Window.partitionBy("extension", directory(F.col("path"))).orderBy(F.desc("modified_at"), "item_id")
    ranked = items(spark, sf_dir).withColumn("place", F.row_number().over(order))
    return ranked.select("item_id", F.when(F.col("is_pinned"), "pinned").when(F.col("place") <= 5, "recent").otherwise("files").alias("section"), "place")
