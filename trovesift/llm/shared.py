"""Shared scratch space, and Arrow plumbing for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trovesift.sources.scratch import shared_folder

#: Bytes of text that a worker turns into arrays at once; bounds its memory, never what it covers.
CHUNK_BYTES = 1 << 18
#: Paths that `scratch` has given, for `sweep`.
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _MADE.append(shared_folder(spark, name))
    return _MADE[-1]


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _MADE:
        _MADE.remove(path)


def made() -> int:
    """How many paths `scratch` has given so far."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete what `scratch` has given since `made()` was `since`, but for the table `keep`."""
    for path in _MADE[since:]:
        if path != keep._scratch:
            delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by `materialize` once nothing reads it."""
    path = getattr(df, "_scratch", None)
    if path:
        delete(df.sparkSession, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into zero-copy slices of about `limit` text bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    array = batch.column(batch.schema.get_field_index(column))
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    from trovesift.llm.textops import offsets_of

    offsets = offsets_of(array)
    start = 0
    while start < n:
        stop = start + 1
        while stop < n and offsets[stop + 1] - offsets[start] <= limit:
            stop += 1
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give a worker's free memory back to the system: workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_slices(df: DataFrame, function: Callable, schema, column: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """`mapInArrow` with `function(RecordBatch) -> RecordBatch | None` on slices of bounded size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out
        release()

    return df.mapInArrow(run, schema)


def map_beside(df: DataFrame, function: Callable, added: str, column: str = "text") -> DataFrame:
    """`df` with more columns: `function(texts: pa.Array) -> list[pa.Array]` on slices of bounded size.

    Columns of `df` with the names of added ones are replaced.
    """
    names = [x.split()[0] for x in added.split(", ")]
    df = df.select(*(c for c in df.columns if c not in names))
    at = df.columns.index(column)

    def run(batch):
        return pa.RecordBatch.from_arrays([*batch.columns, *function(batch.column(at))], [*batch.schema.names, *names])

    from pyspark.sql.types import StructType

    schema = StructType([*df.schema.fields, *df.sparkSession.createDataFrame([], added).schema.fields])
    return map_slices(df, run, schema, column)


def most_frequent(counted: DataFrame, key: str, count: str, most: int) -> list[tuple]:
    """The `most` (key, count) rows with the highest counts, ties by key. `counted` is read twice: materialize it.

    A histogram of the counts' magnitudes first tells which rows can be among them, so
    the last task sorts about `most` rows, not that many from every partition.
    """
    from pyspark.sql import functions as F

    size = F.floor(F.log2(count) * 8).cast("int")
    bins = sorted(((r.b, r.n) for r in counted.groupBy(size.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, seen = 0, 0
    for least, n in bins:  # noqa: B007
        seen += n
        if seen >= most:
            break
    top = counted.where(size >= least).orderBy(F.desc(count), key).limit(most).select(key, count).toArrow()
    return list(zip(*(c.to_pylist() for c in top.columns), strict=True))
