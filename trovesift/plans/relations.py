"""The engine's relations, derived from the driver's tables; in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovesift.config import AS_OF

EXTENSIONS = ("md", "txt", "pdf", "py", "png")
FOLDERS = ("Documents", "Desktop", "Downloads", "Developer/node_modules")
MESSAGES = ("File is not readable", "PDF extraction unavailable (no backend)", "Timeout", "Unknown error")
ACTIONS = {"click": "open", "purchase": "pin", "signup": "unpin", "view": "view", "error": "ignore"}


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # times in the tables are without zone
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, name, extension, path, size, modified_at, is_pinned, lang) of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    docs = docs.withColumn("extension", _pick(EXTENSIONS, F.col("doc_id") % 5)).withColumn("folder", _pick(FOLDERS, F.col("doc_id") % 4))
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.lit("."), F.col("extension"))
    return docs.select(
        F.col("doc_id").alias("item_id"), name.alias("name"), "extension", F.concat(F.lit("/home/u/"), "folder", F.lit("/"), "source", F.lit("/"), name).alias("path"),
        F.col("n_chars").alias("size"), F.timestamp_seconds(F.unix_timestamp(as_of()) - (F.col("doc_id") % 120) * 86400).alias("modified_at"), (F.col("doc_id") % 97 == 0).alias("is_pinned"), "lang",
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, chunk_index, chunk_text): one chunk for each document of 40 characters or more."""
    docs = table(spark, sf_dir, "documents").where("n_chars >= 40")
    return docs.select(F.col("doc_id").alias("item_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("n_chars < 400").select("doc_id")
    when = F.timestamp_seconds(F.unix_timestamp(as_of()) - F.col("doc_id") % 50 * 3600)
    return docs.select(F.col("doc_id").alias("item_id"), F.lit("extraction").alias("stage"), _pick(MESSAGES, F.col("doc_id") % 4).alias("error_message"), when.alias("last_failed_at"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, item_id, action, query, position, timestamp, user_id, value) of each event."""
    events = table(spark, sf_dir, "events")
    action = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))[F.col("event_type")]
    return events.select(
        "event_id", (F.col("event_id") % 1000).alias("item_id"), action.alias("action"), F.col("event_type").alias("query"),
        (F.col("event_id") % 10 + 1).cast("int").alias("position"), F.col("ts").cast("timestamp").alias("timestamp"), "user_id", "value",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


ITEMS = """items AS (
  SELECT doc_id AS item_id, 'doc-' || doc_id || '.' || ext AS name, ext AS extension,
    '/home/u/' || folder || '/' || source || '/doc-' || doc_id || '.' || ext AS path, n_chars AS size,
    TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(doc_id % 120 AS INTEGER)) AS modified_at, doc_id % 97 = 0 AS is_pinned, lang
  FROM (SELECT *, ['md', 'txt', 'pdf', 'py', 'png'][doc_id % 5 + 1] AS ext,
    ['Documents', 'Desktop', 'Downloads', 'Developer/node_modules'][doc_id % 4 + 1] AS folder FROM documents))"""
CONTENT = "content AS (SELECT doc_id AS item_id, 0 AS chunk_index, text AS chunk_text FROM documents WHERE n_chars >= 40)"
FAILURES = """failures AS (
  SELECT doc_id AS item_id, 'extraction' AS stage,
    ['File is not readable', 'PDF extraction unavailable (no backend)', 'Timeout', 'Unknown error'][doc_id % 4 + 1] AS error_message,
    TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(doc_id % 50 AS INTEGER)) AS last_failed_at
  FROM documents WHERE n_chars < 400)"""
FEEDBACK = """feedback AS (
  SELECT event_id, event_id % 1000 AS item_id,
    CASE event_type WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'pin' WHEN 'signup' THEN 'unpin' WHEN 'view' THEN 'view' WHEN 'error' THEN 'ignore' END AS action,
    event_type AS query, CAST(event_id % 10 + 1 AS INTEGER) AS position, ts AS timestamp, user_id, value FROM events)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
