"""Sinks: chunk tables replaced by key, vector generations, JSON exports and settings."""

from __future__ import annotations

import json
from dataclasses import asdict, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovesift.config import DEFAULTS, Settings
from trovesift.sources.snapshots import Snapshots


class VersionedTable:
    """One table with a log of commits: readers see the last one, a commit writes what changes, and writers that change the same keys conflict."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.log = Snapshots(spark, path, {"rows": schema})

    def version(self) -> int:
        return self.log.version()

    def read(self, version: int | None = None) -> DataFrame:
        return self.log.read("rows", version)

    def write(self, df: DataFrame) -> int:
        """These rows in place of all."""
        return self.log.commit({"rows": df}, overwrite=("rows",))

    def replace_keys(self, rows: DataFrame, key: str) -> int:
        """Rows of the keys in `rows` are replaced by them; the others stay."""
        return self.log.commit({"rows": rows}, {"rows": (key, rows)})

    def delete_keys(self, keys: DataFrame, key: str) -> int:
        return self.log.commit({}, {"rows": (key, keys)})

    def clear(self) -> int:
        return self.log.commit({}, overwrite=("rows",))

    def append(self, rows: DataFrame, once: tuple[str, int] | None = None) -> int:
        """Rows beside those that are there, equal ones too; with `once` (who, a number that grows) a repeated append does nothing."""
        return self.log.commit({"rows": rows}, once=once)


#: Schema versions of the catalog: columns that a version adds, with the value that older rows get.
MIGRATIONS: dict[int, dict[str, tuple[str, object]]] = {
    2: {"is_pinned": ("boolean", False)},
    3: {"sensitivity": ("string", "normal"), "content_hash": ("string", None)},
    4: {"indexed_at": ("long", 0)},
}


def migrate(df: DataFrame, version: int, target: int | None = None, steps: dict[int, dict[str, tuple[str, object]]] | None = None) -> tuple[DataFrame, int]:
    """`df` of a schema version brought to `target` (the latest), step by step; columns that are there stay. Going back is refused."""
    steps = MIGRATIONS if steps is None else steps
    target = max(steps) if target is None else target
    if target < version:
        raise ValueError(f"version {version} can't go back to {target}")
    for step in range(version + 1, target + 1):
        for name, (kind, value) in steps.get(step, {}).items():
            if name not in df.columns:
                df = df.withColumn(name, F.lit(value).cast(kind))
    return df, target


def clear_all(*tables: VersionedTable) -> None:
    """Empty all tables that are derived from feedback."""
    for one in tables:
        one.clear()


class VectorStore:
    """Vectors by generation in partitions, and which one is active."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int) -> None:
        self.spark, self.path, self.dimensions = spark, path.rstrip("/"), dimensions
        self.state = VersionedTable(spark, f"{self.path}/state", "generation_id string, is_active boolean")

    def write(self, generation: str, vectors: DataFrame) -> None:
        """Vectors (item_id, passage, embedding); a wrong length fails the job."""
        size = F.when(F.size("embedding") == self.dimensions, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding of a wrong length")))
        vectors.select("item_id", "passage", size.alias("embedding")).write.mode("overwrite").parquet(f"{self.path}/vectors/generation_id={generation}")
        known = self.state.read().where(F.col("generation_id") != generation)
        self.state.write(known.unionByName(self.spark.createDataFrame([(generation, False)], self.state.schema)))

    def activate(self, generation: str) -> None:
        self.state.write(self.state.read().withColumn("is_active", F.col("generation_id") == generation))

    def active(self) -> DataFrame:
        row = self.state.read().where("is_active").first()
        if row is None:
            raise LookupError("no active generation")
        return self.spark.read.parquet(f"{self.path}/vectors/generation_id={row.generation_id}")


def export_json(df: DataFrame, path: str, newest: str | None = None) -> None:
    """A table as JSON lines, newest first by the column `newest`."""
    (df.orderBy(F.desc(newest)) if newest else df).write.mode("overwrite").json(path)


def export_payload(spark: SparkSession, tables: dict[str, DataFrame], settings: Settings, path: str) -> None:
    """All tables and the settings as JSON lines (kind, row) in one folder."""
    rows = [df.select(F.lit(name).alias("kind"), F.to_json(F.struct("*")).alias("row")) for name, df in tables.items()]
    rows.append(spark.createDataFrame([("settings", json.dumps(asdict(settings)))], "kind string, row string"))
    reduce(DataFrame.unionByName, rows).write.mode("overwrite").json(path)


class SettingsStore:
    """Settings in a log of commits: a change is there as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path, "value string")
        self.spark = spark

    def _stored(self) -> dict:
        row = self.table.read().first()
        return json.loads(row.value) if row else {}

    def _put(self, found: dict) -> None:
        self.table.write(self.spark.createDataFrame([(json.dumps(found),)], "value string"))

    def save(self, settings: Settings) -> None:
        self._put(asdict(settings))

    def load(self) -> Settings:
        """Settings with defaults for what is missing; unknown keys are ignored."""
        names = {f.name for f in fields(Settings)}
        return replace(DEFAULTS, **{k: tuple(v) if isinstance(v, list) else v for k, v in self._stored().items() if k in names})

    def remove(self, key: str) -> bool:
        """Take one setting back to its default; whether it was set."""
        found = self._stored()
        if found.pop(key, None) is None:
            return False
        self._put(found)
        return True
