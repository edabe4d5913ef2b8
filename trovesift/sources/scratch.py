"""A folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or by `SparkContext.setCheckpointDir`. Without either, work that writes can't run: no machine-local folder would do on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = told.get() if told.isDefined() else None
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below `shared_root`."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths that `kept` has given, for `sweep`.
_KEPT: list[str] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: its plan ends there, and lost executors cost no more than a read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    _KEPT.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def kept_so_far() -> int:
    return len(_KEPT)


def sweep(spark: SparkSession, since: int, *still: DataFrame) -> None:
    """Delete what `kept` wrote since `kept_so_far()` was `since`, but for the tables `still` read, and the shuffles of plans that are gone."""
    last = {df._kept for df in still}
    for path in _KEPT[since:]:
        if path not in last:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    del _KEPT[since:]
    release_shuffles(spark)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are gone: it does once the driver's JVM has collected them, which else may be after half an hour."""
    gc.collect()
    spark._jvm.System.gc()
