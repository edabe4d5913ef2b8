"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters the records by a seeded hash, uniformly, into buckets that fit in
memory; each bucket is put in a random order by Fisher-Yates (Spark's ``shuffle``) and
written into its shard's folder. Pass two counts the written buckets, which gives each
record its slot: the bucket's start in the shard plus its place in the bucket. Texts are
shuffled once.

The law is ``key``: a record's shard is the highest of its doc_id's hashes with each
shard's number (rendezvous hashing), so one shard more takes records only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovesift.llm.shared import scratch

#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 8 << 20
#: A task for each bucket, up to so many; and so many buckets' starts (40 bytes each) may be broadcast, more are joined by a shuffle.
MOST_TASKS, TOLD_ROWS = 100_000, 500_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard (0 to shards - 1) of a key; null is a key like others."""
    votes = [F.xxhash64(F.lit(seed), key, F.lit(s)) for s in range(shards)]
    return F.array_position(F.array(*votes), F.greatest(*votes) if shards > 1 else votes[0]).cast("int") - 1


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 20260, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write `docs` as Parquet, in random order, into folders shard=0 to shards - 1 of `path`, and read them back.

    The result has the columns of `docs`, law, shard, grown_shard and slot (gapless from 0
    in each shard). All rows stay: null keys and texts, and repeated rows, each with a
    slot of its own, which are scattered like others. Columns of these names are replaced;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "shards")
    added = ("law", "shard", "grown_shard", "slot", "_bucket", "_place")
    docs = docs.select(*(c for c in docs.columns if c not in added))
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    row = F.monotonically_increasing_id()
    scattered = docs.select(
        shard_of(F.col(key), shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), row), F.lit(buckets)).alias("_bucket"),
        F.struct(F.xxhash64(F.lit(seed + 2), F.col(key), row).alias("_order"), *docs.columns).alias("_row"),
    )
    gathered = scattered.repartition(min(shards * buckets, MOST_TASKS), "shard", "_bucket").groupBy("shard", "_bucket").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    mixed = gathered.withColumn("_rows", F.shuffle("_rows", F.lit(seed + 3)))
    placed = mixed.select("shard", "_bucket", F.posexplode("_rows").alias("_place", "_row"))
    placed.select("shard", "_bucket", "_place", *(F.col("_row")[c].alias(c) for c in docs.columns)).write.partitionBy("shard").option("compression", "zstd").parquet(path)

    schema = placed.select("_bucket", "_place", *(F.col("_row")[c].alias(c) for c in docs.columns), "shard").schema
    written = spark.read.schema(schema).parquet(path)
    sizes = written.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    if shards * buckets <= TOLD_ROWS:
        starts = F.broadcast(starts)
    return (
        written.join(starts, ["shard", "_bucket"])
        .withColumn("law", F.lit("key"))
        .withColumn("grown_shard", shard_of(F.col(key), shards + 1, seed))
        .withColumn("slot", (F.col("_start") + F.col("_place")).cast("long"))
        .select(*docs.columns, "law", "shard", "grown_shard", "slot")
    )
