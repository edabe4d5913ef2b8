"""Incremental indexing: change detection, coalescing of events, states, retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovesift.operators.health import transient

#: Kinds of change in the order in which they win.
CHANGES = ("delete", "modified", "new", "rescan")


def rank_of(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CHANGES)), kind)


def coalesce_changes(events: DataFrame) -> DataFrame:
    """One change for each path: the one that wins, the last of equals. events (path, kind, seq)."""
    return events.groupBy("path").agg(F.min(F.struct(rank_of(F.col("kind")).alias("r"), (-F.col("seq")).alias("s"), "kind")).alias("w"), F.count("*").alias("n_events")).select("path", "w.kind", "n_events")


def latest_generation(work: DataFrame) -> DataFrame:
    """`work` (path, generation) with stale: a newer generation of the path exists."""
    return work.withColumn("stale", F.col("generation") < F.max("generation").over(Window.partitionBy("path")))


def detect_changes(catalog: DataFrame, seen: DataFrame, excluded: Column | None = None, metadata_only: Column | None = None, failed: Column | None = None) -> DataFrame:
    """(path, status): new, modified, skipped (same size, time or hash) or deleted. Both have (path, size, mtime, hash).

    Conditions on (path) and on columns of `seen` tell what is excluded, kept as metadata only, or failed to be read.
    """
    c, s = catalog.alias("c"), seen.alias("s")
    joined = c.join(s, F.col("c.path") == F.col("s.path"), "full_outer")
    same = (F.col("c.size") == F.col("s.size")) & (F.col("c.mtime") == F.col("s.mtime"))
    status = (
        F.when(F.col("s.path").isNull(), "deleted").when(F.col("c.path").isNull(), "new").when(same | F.col("c.hash").eqNullSafe(F.col("s.hash")), "skipped").otherwise("modified")
    )
    for rule, name in ((failed, "extraction_failed"), (metadata_only, "metadata_only"), (excluded, "excluded")):
        if rule is not None:
            status = F.when(F.col("s.path").isNotNull() & F.coalesce(rule, F.lit(False)), name).otherwise(status)
    return joined.select(F.coalesce("c.path", "s.path").alias("path"), status.alias("status"))


def record_failures(rows: DataFrame) -> DataFrame:
    """(item_id, stage, failure_count, first, last, message) of failure rows (item_id, stage, message, at)."""
    return rows.groupBy("item_id", "stage").agg(F.count("*").alias("failure_count"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max_by("message", F.struct("at", "message")).alias("message"))


def retry_schedule(failed: DataFrame, most: int = 3) -> DataFrame:
    """Failures worth another try, with the delay before it: 500 ms, doubled twice each time, 8 s at most."""
    delay = F.least(F.lit(8000), (F.lit(500) * F.pow(F.lit(4), F.col("attempt"))).cast("int"))
    return failed.where(transient(F.col("error_message")) & (F.col("attempt") < most)).withColumn("delay_ms", delay)


def first_passages(chunks: DataFrame, most: int = 3) -> DataFrame:
    """The first `most` chunks of each item that aren't blank."""
    order = Window.partitionBy("item_id").orderBy("chunk_index")
    return chunks.where(F.trim("chunk_text") != "").withColumn("ordinal", F.row_number().over(order) - 1).where(F.col("ordinal") < most)


def work_order(work: DataFrame, most: int = 10_000) -> DataFrame:
    """`work` (path, kind, seq) in the order it is done, at most `most` rows of it: by kind, then by age. Only rescans are dropped; what must be done stays."""
    kept = work.where("kind <> 'rescan'")
    spare = F.greatest(F.lit(0), F.lit(most) - F.count("*"))
    left = kept.agg(spare.alias("n")).first().n
    rescans = work.where("kind = 'rescan'").orderBy("seq", "path").limit(int(left))
    return kept.unionByName(rescans).withColumn("priority", rank_of(F.col("kind")).cast("int"))


def lanes(work: DataFrame, live_percent: int = 70, live_most: int = 4000, rebuild_most: int = 20_000) -> DataFrame:
    """Two lanes (lane live or rebuild, seq) dealt into slots: of 100 slots in a row, `live_percent` are live as long as both have work. Each lane takes its first rows up to its cap."""
    caps = {"live": live_most, "rebuild": rebuild_most}
    shares = {"live": live_percent, "rebuild": 100 - live_percent}
    out = []
    for lane, most in caps.items():
        order = Window.orderBy("seq", "path")
        top = work.where(F.col("lane") == lane).orderBy("seq", "path").limit(most).withColumn("_n", F.row_number().over(order) - 1)
        share = shares[lane]
        slot = F.floor(F.col("_n") / share) * 100 + F.col("_n") % share + (0 if lane == "live" else live_percent) if share else F.col("_n") + 10**9
        out.append(top.withColumn("slot", slot.cast("long")).drop("_n"))
    return out[0].unionByName(out[1])


def reindex(state: DataFrame, seen: DataFrame, path: str) -> DataFrame:
    """`state` with one path's rows replaced by what is seen there now, or gone if nothing is."""
    return state.where(F.col("path") != path).unionByName(seen.where(F.col("path") == path).select(*state.columns))


def rebuild(seen: DataFrame, roots: list[str], ignored=()) -> DataFrame:
    """A catalog made anew: what is seen below the roots and may be indexed, each path once, the latest of equals."""
    from trovesift.functions.paths import under, validate

    inside = reduce(lambda a, b: a | b, (under(F.col("path"), r) for r in roots), F.lit(False))
    kept = seen.where(inside & (validate(F.col("path"), F.col("size"), ignored, roots) != "exclude"))
    return kept.groupBy("path").agg(F.max(F.struct("mtime", "size", "hash")).alias("b")).select("path", "b.size", "b.mtime", "b.hash")


def update_hashes(state: DataFrame, hashes: DataFrame) -> DataFrame:
    """`state` (path, hash, ...) with the hashes of (path, hash) where there is one; nothing else changes."""
    new = hashes.groupBy("path").agg(F.max("hash").alias("_hash"))
    return state.join(new, "path", "left").withColumn("hash", F.coalesce("_hash", "hash")).select(*state.columns)
