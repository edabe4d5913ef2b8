"""Embedding side: WordPiece tokens, a model-free embedder, rebuilds of vectors, and an inverted-file index with recall to measure."""

from __future__ import annotations

import re
import time
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovesift.operators.indexing import first_passages
from trovesift.operators.vector import dot, normalize
from trovesift.sources.snapshots import Snapshots

#: Tokens of one text, and of a pair, beside the marks.
MOST_TOKENS, MOST_PAIR = 510, 509
#: Vectors that centroids are fitted on.
SAMPLE = 20_000
#: Share of deleted vectors beyond which an index is built anew.
DELETED_SHARE = 0.20


def basic_tokens(text: str) -> list[str]:
    """Lower-case words and single signs, without marks and control characters."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn" and (c in "\t\n\r" or unicodedata.category(c)[0] != "C"))
    return re.findall(r"[^\W_]+|[^\w\s]|_", plain)


def word_pieces(word: str, vocabulary: dict[str, int], unknown: str = "[UNK]", longest: int = 200, piece: int | None = None) -> list[str]:
    """The longest known piece from each place on; later pieces begin with ##. A word that doesn't come out, or is longer than `longest`, is unknown. No piece has more than `piece` letters, if that is given."""
    if len(word) > longest:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        furthest = len(word) if piece is None else min(len(word), at + piece)
        end = next((e for e in range(furthest, at, -1) if mark + word[at:e] in vocabulary), None)
        if end is None:
            return [unknown]
        out.append(mark + word[at:end])
        at = end
    return out


def encode_text(text: str, vocabulary: dict[str, int]) -> list[int]:
    """[CLS], at most MOST_TOKENS pieces, [SEP], as ids."""
    pieces = [p for w in basic_tokens(text) for p in word_pieces(w, vocabulary)][:MOST_TOKENS]
    return [vocabulary[p] for p in ["[CLS]", *pieces, "[SEP]"]]


def encode_pair(a: str, b: str, vocabulary: dict[str, int]) -> tuple[list[int], list[int]]:
    """Ids and segment numbers of a pair; the second text is cut first, then the first."""
    first, second = ([p for w in basic_tokens(t) for p in word_pieces(w, vocabulary)] for t in (a, b))
    second = second[: max(0, MOST_PAIR - min(len(first), MOST_PAIR))]
    first = first[: MOST_PAIR - len(second)]
    pieces = ["[CLS]", *first, "[SEP]", *second, "[SEP]"]
    return [vocabulary[p] for p in pieces], [0] * (len(first) + 2) + [1] * (len(second) + 1)


def wordpiece(vocabulary: dict[str, int]):
    """A column function from texts to ids, as `encode_text`; a batch's words are cut once each."""
    piece = max((len(p.removeprefix("##")) for p in vocabulary), default=1)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list[int]] = {}

        def ids(word: str) -> list[int]:
            if word not in known:
                known[word] = [vocabulary[p] for p in word_pieces(word, vocabulary, piece=piece)]
            return known[word]

        def encode(text: str | None) -> list[int]:
            out: list[int] = []
            for word in basic_tokens(text or ""):
                out += ids(word)
                if len(out) >= MOST_TOKENS:
                    break
            return [vocabulary["[CLS]"], *out[:MOST_TOKENS], vocabulary["[SEP]"]]

        return pd.Series([encode(t) for t in texts])

    return run


class Breaker:
    """Stops asking a model that failed `most` times in a row; after a rest it is asked once more, and again as usual if that works."""

    def __init__(self, most: int = 5, rest: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.rest, self.clock = most, rest, clock
        self.failures, self.opened = 0, None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.rest else "open"

    def ready(self) -> bool:
        return self.state != "open"

    def report(self, worked: bool) -> None:
        if worked:
            self.failures, self.opened = 0, None
        else:
            self.failures += 1
            if self.failures >= self.most or self.opened is not None:
                self.opened = self.clock()


def deterministic(text: Column, dimensions: int, seed: int = 0) -> Column:
    """A unit vector that follows from the text alone: a linear congruential sequence from its digest, for tests and as a fallback."""
    a, c, steps = 1, 0, []
    for _ in range(dimensions):  # the k-th state is a * start + c
        a, c = a * 1664525 % (1 << 32), (c * 1664525 + 1013904223) % (1 << 32)
        steps.append((a, c))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 8), 16, 10).cast("long")
    low, full = F.lit(0xFFFF).cast("long"), F.lit(0xFFFFFFFF).cast("long")

    def values(start: Column) -> Column:
        high, low_part = F.shiftright(start, 16), start.bitwiseAND(low)

        def value(x: Column) -> Column:
            state = (x["a"] * low_part + F.shiftleft((x["a"] * high).bitwiseAND(low), 16) + x["c"]).bitwiseAND(full)
            return state.bitwiseAND(low) / 65535.0 * 2.0 - 1.0

        return F.transform(table, value)

    table = F.array(*(F.struct(F.lit(x).cast("long").alias("a"), F.lit(y).cast("long").alias("c")) for x, y in steps))
    once = lambda x, function: F.element_at(F.transform(F.array(x), function), 1)  # noqa: E731 - a lambda's variable: the text is digested once, not for each component
    return once(once(start, values), normalize)


def embed(df: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None, dimensions: int, column: str = "text", most_failures: int = 5, rest: float = 30.0, failed=None) -> DataFrame:
    """`df` with `embedding`: batches through a model (texts to a matrix). A failing batch is tried row by row; rows that fail are null.

    After `most_failures` batches in a row without any result a task lets the model rest
    for `rest` seconds; rows in between are null. `failed`, an accumulator, counts rows
    that came out null. Without a model the vectors are those of `deterministic`.
    """
    if embedder is None:
        return df.withColumn("embedding", deterministic(F.coalesce(F.col(column), F.lit("")), dimensions))

    def run(frames):
        return _embed_frames(frames, embedder, dimensions, column, Breaker(most_failures, rest), failed)

    return df.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, embedding array<double>")


def _embed_frames(frames, embedder, dimensions, column, breaker: Breaker, failed=None):
    for frame in frames:
        texts = frame[column].fillna("").tolist()
        rows: list = [None] * len(texts)
        if texts and breaker.ready():
            try:
                rows = [v.tolist() for v in np.asarray(embedder(texts), float).reshape(len(texts), dimensions)]
            except Exception:  # a model fails in ways of its own
                for k, text in enumerate(texts):
                    try:
                        rows[k] = np.asarray(embedder([text]), float).reshape(dimensions).tolist()
                    except Exception:
                        rows[k] = None
            breaker.report(any(x is not None for x in rows))
        if failed is not None:
            failed.add(sum(x is None for x in rows))
        yield frame.assign(embedding=rows)


def embed_missing(spark: SparkSession, log: Snapshots, table: str, chunks: DataFrame, embedder, dimensions: int, once: tuple[str, int] | None = None) -> int:
    """Embed the chunks (item_id, passage, text) that a table of vectors lacks, and commit what came out; how many are still missing.

    Rows that failed stay missing, so the next call, by a stream's batch or a schedule,
    takes them up again; a repeated batch (`once`) does nothing.
    """
    there = log.read(table)
    lacking = chunks.select("item_id", "passage", "text").join(there.select("item_id", "passage"), ["item_id", "passage"], "left_anti")
    made = embed(lacking, embedder, dimensions).where("embedding is not null").select("item_id", "passage", "embedding")
    log.commit({table: made}, once=once)
    return chunks.select("item_id", "passage").join(log.read(table).select("item_id", "passage"), ["item_id", "passage"], "left_anti").count()


def rebuild(chunks: DataFrame, embedder, dimensions: int, most_passages: int = 3, most_chars: int = 8192) -> DataFrame:
    """(item_id, passage, embedding) for a new generation: the first passages of each item, cut, embedded; rows that fail are left out."""
    passages = first_passages(chunks, most_passages).select("item_id", F.col("ordinal").cast("int").alias("passage"), F.substring("chunk_text", 1, most_chars).alias("text"))
    return embed(passages, embedder, dimensions).where("embedding is not null").select("item_id", "passage", "embedding")


def mark_deleted(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """`vectors` (item_id, is_deleted, ...) with those of `gone` (item_id) marked."""
    marked = gone.select("item_id").distinct().withColumn("_gone", F.lit(True))
    return vectors.join(marked, "item_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def needs_rebuild(vectors: DataFrame) -> DataFrame:
    """(total, deleted, rebuild): whether too many vectors are only marked as deleted."""
    counted = vectors.agg(F.count("*").alias("total"), F.count_if("is_deleted").alias("deleted"))
    return counted.withColumn("rebuild", (F.col("total") > 0) & (F.col("deleted") > DELETED_SHARE * F.col("total")))


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of a sample of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    found = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        nearest = (sample @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 0, sums / np.maximum(norms, 1e-12), found)
    return found


class InvertedFile:
    """Vectors in folders by their nearest centroid; a search reads a few folders. `vector.knn` is the exact way beside it."""

    def __init__(self, spark: SparkSession, path: str, found: np.ndarray) -> None:
        self.spark, self.path, self.centroids = spark, path.rstrip("/"), found

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = 16) -> InvertedFile:
        """Centroids come from SAMPLE vectors at most, by a seeded hash; every vector (item_id, embedding) is indexed."""
        spark = vectors.sparkSession
        rows = vectors.orderBy(F.xxhash64(F.lit("centroids"), "item_id"), "item_id").limit(SAMPLE).select("embedding").toArrow()
        sample = np.array(rows.column(0).to_pylist(), np.float32)
        sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
        told = spark.sparkContext.broadcast(centroids(sample, min(lists, len(sample))))

        def deal(batches):
            for batch in batches:
                if batch.num_rows:
                    values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((values @ told.value.T).argmax(1).astype(np.int32))], ["item_id", "embedding", "list"])

        dealt = vectors.select("item_id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(deal, "item_id long, embedding array<float>, list int")
        dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path.rstrip('/')}/vectors")
        return cls(spark, path, told.value)

    def search(self, query: list[float], k: int, probes: int = 12) -> DataFrame:
        """The best `k` (item_id, similarity) among the vectors of the `probes` nearest lists. Vectors without clusters need most of the lists; clustered ones a few."""
        near = np.argsort(-(self.centroids @ np.array(query, np.float32)), kind="stable")[:probes].tolist()
        rows = self.spark.read.schema("item_id long, embedding array<float>, list int").parquet(f"{self.path}/vectors").where(F.col("list").isin(near))
        return rows.select("item_id", dot(F.col("embedding"), F.array(*map(F.lit, query))).alias("similarity")).orderBy(F.desc("similarity"), "item_id").limit(k)
