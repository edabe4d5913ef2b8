"""Structured Streaming: sources, dedupe, windows, coalescing and exactly-once merges."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovesift.operators.indexing import rank_of
from trovesift.sources.snapshots import Snapshots


def stream_table(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of a Parquet file or folder, with the schema of what is there; `files` bounds a micro-batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        single = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
    except Exception as error:  # a path the file system doesn't know
        raise FileNotFoundError(path) from error
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


@contextmanager
def keyed_state(spark: SparkSession):
    """While a stream is started: the state store that operators with state by key and timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def dedupe(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once; the state is bounded by the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def activity(events: DataFrame, width: str = "1 hour", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Tumbling counts by event type; windows without events don't appear."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), "user_id").agg(F.count("*").alias("n"))


def run_now(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there into Parquet at `path`, exactly once by its checkpoint."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Write each micro-batch to a folder of its own, once: a repeated batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def classify(exists: Column, removed: Column, created: Column, modified: Column, renamed: Column, is_folder: Column) -> Column:
    """The kind of a change from its flags: what isn't there any more is a delete, folders are scanned again."""
    return (
        F.when(removed | ~exists, "delete").when(is_folder, "rescan").when(created, "new").when(modified, "modified").when(renamed, "new").otherwise("rescan")
    )


CHANGE = "path string, kind string, seq long"


def _changes(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path, {"paths": CHANGE})


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The paths (path, kind, seq) that are there, without those whose last change was a delete."""
    return _changes(spark, path).read("paths").where("kind <> 'delete'")


def merge_changes(changes: DataFrame, path: str, checkpoint: str, name: str | None = None, late: int | None = None) -> None:
    """A change stream (path, kind, seq) into a `catalog`: the last change of each path (of equal numbers the kind that wins), a commit for each batch.

    The result is the same however the changes are dealt into batches. A commit writes the paths that changed, not the catalog. A batch that comes again, by
    the stream's `name` (its checkpoint unless given), isn't applied again. An older change
    than one that was merged doesn't undo it: deleted paths stay as tombstones with their
    numbers, so a late change doesn't bring one back. Tombstones over `late` numbers behind
    the newest change are forgotten, if `late` is given; no change may be later than that.
    """
    log = _changes(changes.sparkSession, path)

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        last = F.max(F.struct("seq", (-rank_of(F.col("kind"))).alias("r"), "kind"))
        now = batch.where("path is not null and seq is not null").groupBy("path").agg(last.alias("l")).select("path", "l.kind", "l.seq")
        state = log.state()
        known = log.read("paths", state=state).join(now.select("path"), "path", "left_semi").select("path", F.col("seq").alias("_old"))
        new = now.join(known, "path", "left").where("_old is null or seq > _old").select("path", "kind", "seq")
        gone = new.select("path")
        if late is not None:
            last = batch.agg(F.max("seq")).first()[0]
            old = log.read("paths", state=state).where((F.col("kind") == "delete") & (F.col("seq") < F.lit(last) - late)).select("path")
            gone = gone.unionByName(old)
        log.commit({"paths": new}, {"paths": ("path", gone)}, once=(name or checkpoint, batch_id), read=state.version)
        log.merge("paths")
        batch.unpersist()

    changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
