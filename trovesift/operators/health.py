"""Health and availability of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Messages of failures that are expected, not critical; and of those worth another try.
EXPECTED_LIKE = (
    "PDF extraction unavailable (%",
    "OCR extraction unavailable (%",
    "Leptonica failed to read image%",
    "Extension % is not supported by extractor",
    "File size % exceeds configured limit %",
)
EXPECTED_EQUAL = (
    "File does not exist or is not a regular file",
    "File is not readable",
    "Failed to load PDF document",
    "PDF is encrypted or password-protected",
    "File appears to be a cloud placeholder (size reported but no content readable)",
)
PLACEHOLDER = "File appears to be a cloud placeholder%"
TRANSIENT = ("Inaccessible", "Timeout", "Unknown error")


def expected_gap(stage: Column, message: Column) -> Column:
    like = message.isin(*EXPECTED_EQUAL)
    for pattern in EXPECTED_LIKE:
        like = like | message.like(pattern)
    return (stage == "extraction") & like


def transient(message: Column) -> Column:
    return message.isin(*TRANSIENT)


def index_health(items: DataFrame, content: DataFrame, failures: DataFrame) -> DataFrame:
    """One row of counts, each from one pass over its table, and the status they give."""
    gap = F.coalesce(expected_gap(F.col("stage"), F.col("error_message")), F.lit(False))
    a = items.agg(F.count("*").alias("n_items"))
    b = content.agg(F.count("*").alias("n_chunks"), F.countDistinct("item_id").alias("n_with"))
    c = failures.agg(F.count("*").alias("n_failures"), F.count_if(gap).alias("n_expected"), F.count_if(~gap).alias("n_critical"))
    return a.join(b).join(c).select(  # three single rows
        "n_items", "n_chunks", (F.col("n_items") - F.col("n_with")).alias("n_without_content"), "n_failures", "n_expected", "n_critical",
        (F.col("n_critical") == 0).alias("healthy"), F.when(F.col("n_critical") > 0, "critical_failures").otherwise("healthy").alias("status"),
        F.round(F.when(F.col("n_items") == 0, 100.0).otherwise(100.0 * F.col("n_with") / F.col("n_items")), 6).alias("content_coverage"),
    )


def availability(items: DataFrame, content: DataFrame, failures: DataFrame) -> DataFrame:
    """`items` with availability: available, offline_placeholder or extract_failed."""
    has = content.select("item_id").distinct().withColumn("_has", F.lit(True))
    last = failures.groupBy("item_id").agg(F.max_by("error_message", "last_failed_at").alias("_error"))
    label = F.when(F.col("_has"), "available").when(F.col("_error").like(PLACEHOLDER), "offline_placeholder").when(F.col("_error").isNotNull(), "extract_failed").otherwise("available")
    return items.join(has, "item_id", "left").join(last, "item_id", "left").withColumn("availability", label).drop("_has", "_error")


def query_counters(log: DataFrame) -> DataFrame:
    """One row of counts over a log of searches (rewrite_applied, admitted, suppressed)."""
    return log.agg(
        F.count("*").alias("searches"), F.count_if("rewrite_applied").alias("rewrites_applied"), F.sum("admitted").cast("long").alias("semantic_admitted"), F.sum("suppressed").cast("long").alias("semantic_suppressed")
    )


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """`df` that counts as it runs: rows, and rows for each condition. Read `observation.get` after an action."""
    observation = Observation(name)
    return df.observe(observation, F.count("*").alias("rows"), *(F.count_if(c).alias(k) for k, c in counters.items())), observation


def service_health(counts: DataFrame, vectors: int, rebuilding: bool = False, indexer: bool = True) -> DataFrame:
    """The row of `index_health` with the status of the whole service, which of four holds first, and the share of items with vectors (100 if there are no items)."""
    status = F.when(F.lit(rebuilding), "rebuilding").when(F.lit(not indexer), "indexer_unavailable").otherwise(F.col("status"))
    share = F.when(F.col("n_items") == 0, 100.0).otherwise(100.0 * vectors / F.col("n_items"))
    return counts.withColumn("overall_status", status).withColumn("semantic_coverage", F.round(share, 6))


def recent_errors(failures: DataFrame, most: int = 25) -> DataFrame:
    return failures.orderBy(F.desc("last_failed_at"), "item_id").limit(most)
