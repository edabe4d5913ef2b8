"""Keyed merges, unions of candidates and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def open_counts(feedback: DataFrame) -> DataFrame:
    return feedback.where("action = 'open'").groupBy("item_id").agg(F.count("*").alias("open_count"), F.max("timestamp").alias("last_open"))


def union_origins(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """(item_id, origins): the bits of all lists an item came from."""
    rows = reduce(DataFrame.unionByName, (df.select("item_id", F.lit(bit).alias("origin")) for df, bit in parts))
    return rows.groupBy("item_id").agg(F.bit_or("origin").alias("origins"))


def append_missing(hits: DataFrame, others: DataFrame, most: int) -> DataFrame:
    """(item_id, origin) of hits, and of at most `most` others with the shortest names that aren't among them."""
    more = others.join(hits.select("item_id"), "item_id", "left_anti").orderBy(F.length("name"), "name", "item_id").limit(most)
    return hits.select("item_id", F.lit("lexical").alias("origin")).unionByName(more.select("item_id", F.lit("name").alias("origin")))


def latest_pins(feedback: DataFrame) -> DataFrame:
    pins = feedback.where("action in ('pin', 'unpin')")
    last = pins.groupBy("item_id").agg(F.max_by("action", F.struct("timestamp", "event_id")).alias("action"))
    return last.select("item_id", (F.col("action") == "pin").alias("is_pinned"))


def top_per_group(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)


def upsert(state: DataFrame, changes: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """`state` with `changes` merged by key; columns in `keep` stay as they were where the key exists."""
    old, new = state.alias("o"), changes.alias("n")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*(pick(c).alias(c) for c in state.columns))


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "item_id") -> dict[str, DataFrame]:
    """Each table without the rows of deleted keys."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}
