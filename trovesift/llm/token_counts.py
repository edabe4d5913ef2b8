"""Token counts as delta-maintained rollups.

A ledger is a folder of committed batches. A batch holds signed sums by source, language
and tokenizer version: an insert adds a document and its tokens, a delete takes them
away, a revision takes the old count away and adds the new one. Totals are the sums over
all committed batches, so nothing is counted again when documents change.

A batch is written under a fresh name, and counts once a marker with its id names it. A
marker can be created only once, so committing an id again, by a retry or a second run,
changes nothing, and what a failed run has written counts for nothing.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")
DELTAS = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"


def bpe_counts(docs: DataFrame, paths: dict[str, str]) -> DataFrame:
    """`docs` (text, ...) with a count of tokens by each tokenizer file: column name to path. One scan; null texts have none; columns of these names are replaced."""
    import numpy as np
    import pyarrow as pa

    from trovesift.llm.shared import map_beside
    from trovesift.llm.tokens import BpeEncoder

    count = lambda path, texts: pa.array(np.diff(BpeEncoder.load(path).encode(texts)[1]), pa.int64())
    added = ", ".join(f"{name} long" for name in paths)
    return map_beside(docs.withColumn("text", F.col("text").cast("string")), lambda texts: [count(path, texts) for path in paths.values()], added)


def inserts(counted: DataFrame) -> DataFrame:
    """Changes (sign, n_tokens, and KEYS) for documents that are new."""
    return counted.select(*KEYS, F.lit(1).alias("sign"), "n_tokens")


def deletes(counted: DataFrame) -> DataFrame:
    """Changes for documents that go, with the counts they were inserted with."""
    return counted.select(*KEYS, F.lit(-1).alias("sign"), "n_tokens")


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from one state of counts (doc_id, KEYS, n_tokens) to another: rows in one only, or with another count or key."""
    gone, new = before.exceptAll(after.select(*before.columns)), after.select(*before.columns).exceptAll(before)
    return deletes(gone).unionByName(inserts(new))


def revised(counted: DataFrame, was: str, now: str) -> DataFrame:
    """Changes where the counts in the columns `was` and `now` differ: no join is needed if both are at hand."""
    moved = counted.where(f"{was} <> {now}")
    signed = F.inline(F.array(F.struct(F.lit(-1).alias("sign"), F.col(was).alias("n_tokens")), F.struct(F.lit(1).alias("sign"), F.col(now).alias("n_tokens"))))
    return moved.select(*KEYS, signed)


class Ledger:
    """Committed batches under `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        target = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = target.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _named(self, batch_id: str) -> str | None:
        """The data that a batch's marker names."""
        if not self.files.exists(self._at("commits", batch_id)):
            return None
        stream = self.files.open(self._at("commits", batch_id))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def committed(self, batch_id: str) -> bool:
        return bool(self._named(batch_id))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add the sums of `changes` (sign, n_tokens, KEYS) under `batch_id`; False if that id is committed already.

        Null keys are groups of their own, null counts are 0; an empty batch is committed, too.
        """
        if self.committed(batch_id):
            return False
        signed = F.coalesce(F.col("n_tokens"), F.lit(0)) * F.col("sign")
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("d_docs"), F.sum(signed).cast("long").alias("d_tokens"))
        name = uuid.uuid4().hex
        sums.coalesce(16).write.parquet(f"{self.path}/data/{name}")
        return self._mark(batch_id, name)

    def _mark(self, batch_id: str, name: str) -> bool:
        """Create the marker, unless there is one; an empty one, of a driver lost in between, is taken over."""
        marker = self._at("commits", batch_id)
        if self.files.exists(marker) and not self._named(batch_id):
            self.files.delete(marker, False)
        try:
            stream = self.files.create(marker, False)
        except Py4JJavaError:
            self.files.delete(self._at("data", name), True)
            return False
        stream.write(bytearray(name.encode()))
        stream.close()
        return True

    def totals(self) -> DataFrame:
        """(KEYS, n_docs, n_tokens) over all committed batches; groups without documents and tokens are gone."""
        found = self.files.listStatus(self._at("commits")) if self.files.exists(self._at("commits")) else []
        names = [x for x in (self._named(f.getPath().getName()) for f in found) if x]
        if not names:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
        deltas = self.spark.read.schema(DELTAS).parquet(*(f"{self.path}/data/{x}" for x in names))
        sums = deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")
