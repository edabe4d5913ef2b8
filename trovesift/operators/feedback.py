"""Feedback statistics: preferences, affinity, incremental rollups, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovesift.config import DEFAULTS, Settings
from trovesift.functions.paths import directory

# Categories of extensions.
CATEGORIES = {
    "code": "py js ts tsx jsx cpp c h hpp go rs java rb php swift kt scala sh bash zsh",
    "document": "md txt pdf docx doc rtf tex org rst csv",
    "media": "png jpg jpeg gif svg mp3 mp4 mov wav webp ico",
}
#: Ties go to the first of these.
PRIORITY = ("media", "document", "code", "other")


def since(column: str, now: Column, days: int) -> Column:
    return F.col(column) >= now - F.make_interval(days=F.lit(days))


def path_preferences(opens: DataFrame, now: Column, most: int = 50, s: Settings = DEFAULTS) -> DataFrame:
    """(directory, count, boost) of the folders used most: opens (path, timestamp)."""
    counted = opens.where(since("timestamp", now, s.feedback_days)).groupBy(directory(F.col("path")).alias("directory")).agg(F.count("*").alias("count"))
    top = counted.where("directory <> ''").orderBy(F.desc("count"), "directory").limit(most)
    return top.withColumn("boost", F.least(F.col("count") / 5.0, F.lit(15.0)))


def category(extension: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, members in CATEGORIES.items():
        out = out.when(F.lower(extension).isin(*members.split()), name)
    return out.otherwise("other")


def type_affinity(opens: DataFrame, now: Column, s: Settings = DEFAULTS) -> DataFrame:
    """(category, count, share, is_majority): the leading category counts if it has more than 0.6 of all."""
    counted = opens.where(since("timestamp", now, s.affinity_days)).groupBy(category(F.col("extension")).alias("category")).agg(F.count("*").alias("count"))
    total = counted.agg(F.sum("count").alias("total"), F.max_by("category", F.struct("count", -F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("category")))).alias("leader"))
    share = F.col("count") / F.col("total")
    return counted.join(total).select("category", "count", F.round(share, 6).alias("share"), ((share > 0.6) & (F.col("category") == F.col("leader"))).alias("is_majority"))


def interaction_boost(rows: DataFrame, now: Column, s: Settings = DEFAULTS) -> DataFrame:
    """(query, item_id, boost): 5 for each interaction of a query with an item, 25 at most."""
    counted = rows.where(since("timestamp", now, s.feedback_days)).groupBy("query", "item_id").agg(F.count("*").alias("n"))
    return counted.select("query", "item_id", F.least(5 * F.col("n"), F.lit(25)).cast("long").alias("boost"))


def rollup(rows: DataFrame) -> DataFrame:
    """(item_id, open_count, last_open, total) of feedback rows."""
    return rows.groupBy("item_id").agg(F.count_if(F.col("action") == "open").alias("open_count"), F.max(F.when(F.col("action") == "open", F.col("timestamp"))).alias("last_open"), F.count("*").alias("total"))


def merge_rollup(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Add counts, keep the latest open: what was counted before is not read again."""
    return rollup_sum(state.unionByName(delta))


def rollup_sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item_id").agg(F.sum("open_count").alias("open_count"), F.max("last_open").alias("last_open"), F.sum("total").alias("total"))


def prune(rows: DataFrame, now: Column, days: int, column: str = "timestamp") -> DataFrame:
    return rows.where(since(column, now, days))
