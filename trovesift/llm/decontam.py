"""Benchmark decontamination by winnowing.

Schleimer, Wilkerson and Aiken, "Winnowing" (2003): of every `w` consecutive k-gram
hashes the smallest is kept as a fingerprint. A shared span of t = w + k - 1 words has
the same w k-grams in both texts, so it keeps the same fingerprint. With t = the window
of the rule, each occurring window shares a fingerprint, and extending each shared
fingerprint word by word, left and right, finds all maximal shared spans. Benchmark
items shorter than the window are one window of their own length, matched by its hash.

Small benchmarks (by a check of their size) are told to all tasks as a sorted index;
larger ones are joined to the documents' fingerprints by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovesift.llm import textops
from trovesift.llm.shared import map_beside, map_slices, materialize

#: Rule: words in a window, words in a fingerprint's k-gram.
WINDOW, GRAM = 13, 5
#: Benchmarks of at most so many bytes of text are broadcast.
TOLD_BYTES = 32 << 20


def words_of(texts: pa.Array) -> textops.Spans:
    data, offsets = textops.text_bytes(texts)
    return textops.Spans(textops.lower_ascii(data), offsets, textops.ALNUM)


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest of each w consecutive hashes (the rightmost of equals)."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.int64)
    if n < w:
        return np.array([n - 1 - int(np.argmin(grams[::-1]))])
    windows = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
    return np.unique(np.arange(n - w + 1) + w - 1 - windows.argmin(1))


@dataclass
class Index:
    """Benchmark items as word hashes, with their sorted fingerprints and whole short items by length."""

    ids: list[str]
    words: np.ndarray
    first: np.ndarray
    prints: np.ndarray
    at: np.ndarray
    item: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def build_index(ids: list, texts: list, window: int = WINDOW, gram: int = GRAM) -> Index:
    spans = words_of(pa.array(texts, pa.string()))
    words = textops.span_hashes(spans.data, spans.start, spans.end)
    prints, at, item, short = [], [], [], defaultdict(list)
    for k, (a, b) in enumerate(zip(spans.first[:-1].tolist(), spans.first[1:].tolist(), strict=True)):
        if b - a >= window:
            grams = textops.ngram_hashes(words[a:b], gram)
            places = winnow(grams, window - gram + 1)
            prints.append(grams[places])
            at.append(places + a)
            item.append(np.full(len(places), k))
        elif b > a:
            short[b - a].append((textops.ngram_hashes(words[a:b], b - a)[0], k))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    prints, at, item = join(prints, np.uint64), join(at, np.int64), join(item, np.int64)
    order = np.argsort(prints, kind="stable")
    index = Index([str(x) for x in ids], words, spans.first, prints[order], at[order], item[order])
    for length, rows in short.items():
        rows.sort()
        index.short[length] = (np.array([h for h, _ in rows], np.uint64), np.array([k for _, k in rows]))
    return index


def _extend(words: np.ndarray, a: int, b: int, p: int, other: np.ndarray, c: int, d: int, q: int) -> tuple[int, int]:
    """The maximal span [x, y) around p of words[a:b] that equals other[c:d] around q."""
    back = min(p - a, q - c)
    same = words[p - back : p][::-1] == other[q - back : q][::-1]
    x = p - (back if same.all() else int(np.argmin(same)))
    ahead = min(b - p, d - q)
    same = words[p : p + ahead] == other[q : q + ahead]
    return x, p + (ahead if same.all() else int(np.argmin(same)))


def matches(texts: pa.Array, index: Index, window: int = WINDOW, gram: int = GRAM):
    """For each text: words, words hit, the items found (positions), and the hit spans [(first word, end, item)]."""
    spans = words_of(texts)
    words = textops.span_hashes(spans.data, spans.start, spans.end)
    grams = textops.ngram_hashes(words, gram)
    shorts = {n: textops.ngram_hashes(words, n) for n in index.short}
    known = np.zeros(len(grams), bool)
    if len(index.prints):
        place = np.minimum(np.searchsorted(index.prints, grams), len(index.prints) - 1)
        known = index.prints[place] == grams
    for a, b in zip(spans.first[:-1].tolist(), spans.first[1:].tolist(), strict=True):
        hit, found, where = np.zeros(b - a, bool), set(), []
        if b - a >= window and known[a : b - gram + 1].any():
            own = grams[a : b - gram + 1]
            kept = winnow(own, window - gram + 1)
            done: dict[tuple[int, int], int] = {}  # (item, diagonal): end of the last span looked at
            for p in kept[known[a + kept]].tolist():
                low, high = np.searchsorted(index.prints, own[p], "left"), np.searchsorted(index.prints, own[p], "right")
                for e in range(low, high):
                    k, q = int(index.item[e]), int(index.at[e])
                    if done.get((k, q - p), -1) > p:
                        continue
                    c, d = int(index.first[k]), int(index.first[k + 1])
                    x, y = _extend(words, a, b, a + p, index.words, c, d, q)
                    done[k, q - p] = y - a
                    if y - x >= window:
                        hit[x - a : y - a] = True
                        found.add(k)
                        where.append((x - a, y - a, k))
        for n, (hashes, items) in index.short.items():
            if b - a >= n:
                own = shorts[n][a : b - n + 1]
                low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
                for p in np.flatnonzero(high > low).tolist():
                    hit[p : p + n] = True
                    for e in range(int(low[p]), int(high[p])):
                        found.add(int(items[e]))
                        where.append((p, p + n, int(items[e])))
        yield b - a, int(hit.sum()), found, where


ADDED = "n_words long, n_hit long, item_ids array<string>, spans array<struct<first:long,end:long,item_id:string>>"


def _columns(rows: list, ids: list[str]) -> list[pa.Array]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("item_id", pa.string())]))
    return [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([sorted({ids[k] for k in r[2]}) for r in rows], pa.list_(pa.string())),
        pa.array([[{"first": x, "end": y, "item_id": ids[k]} for x, y, k in sorted(r[3])] for r in rows], kind),
    ]


def _told(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    rows = items.collect()
    told = docs.sparkSession.sparkContext.broadcast(build_index([r.item_id for r in rows], [r.text for r in rows], window, gram))

    def function(texts):
        return _columns(list(matches(texts, told.value, window, gram)), told.value.ids)

    return map_beside(docs, function, ADDED)


def _joined(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """The same by a shuffled join of fingerprints: the items that share one with a document come to it, salted by item, to be matched there."""

    def prints(batch):
        index_of, out = [], []
        spans = words_of(batch.column(1))
        words = textops.span_hashes(spans.data, spans.start, spans.end)
        keys = batch.column(0).to_pylist()
        lengths = batch.column(2).to_pylist()
        for k, (a, b) in enumerate(zip(spans.first[:-1].tolist(), spans.first[1:].tolist(), strict=True)):
            for n in lengths[k]:
                if b - a < n:
                    continue
                grams = textops.ngram_hashes(words[a:b], gram if n == window else n)
                own = np.unique(grams[winnow(grams, window - gram + 1)] if n == window else grams)
                index_of.extend([(keys[k], n)] * len(own))
                out.append(own)
        flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in index_of], pa.int64()), pa.array([n for _, n in index_of], pa.int32()), pa.array(flat.view(np.int64))], ["key", "n", "print"]
        )

    word_count = F.regexp_count(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    items = items.withColumn("key", F.monotonically_increasing_id()).withColumn("n", F.least(F.coalesce(word_count, F.lit(0)), F.lit(window)))
    items = materialize(items.where("n > 0").select("key", "text", F.array("n").alias("lengths"), "item_id"), "items")
    lengths = [r.n for r in items.select(F.explode("lengths").alias("n")).distinct().collect()]  # 1 to window
    added = [x.split()[0] for x in ADDED.split(", ")]
    rows = docs.select(*(c for c in docs.columns if c not in added)).withColumn("_key", F.monotonically_increasing_id())
    rows = materialize(rows, "rows")
    texts = rows.select(F.col("_key").alias("key"), "text", F.array(*map(F.lit, lengths)).cast("array<int>").alias("lengths"))
    schema = "key long, n int, print long"
    of_items = map_slices(items.select("key", "text", "lengths"), prints, schema).distinct().withColumnRenamed("key", "item")
    of_docs = map_slices(texts, prints, schema).distinct()
    pairs = of_docs.join(of_items, ["n", "print"]).select("key", "item").distinct()
    near = pairs.join(items.select(F.col("key").alias("item"), F.col("text").alias("item_text"), "item_id"), "item")
    near = near.join(texts.select("key", "text"), "key")

    def verify(batch):
        texts, item_texts = batch.column(1), batch.column(2)
        ids, keys, out = batch.column(3).to_pylist(), batch.column(0), []
        for k in range(batch.num_rows):
            index = build_index([ids[k]], item_texts.slice(k, 1).to_pylist(), window, gram)
            out.extend(matches(texts.slice(k, 1), index, window, gram))
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array([str(x) for x in ids], pa.string()),
                pa.array([[{"first": x, "end": y} for x, y, _ in sorted(r[3])] for r in out], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            ],
            ["key", "item_id", "found"],
        )

    found = map_slices(near.select("key", "text", "item_text", "item_id"), verify, "key long, item_id string, found array<struct<first:long,end:long>>").where(F.size("found") > 0)
    spans = found.select("key", "item_id", F.inline("found")).groupBy("key").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sort_array(F.collect_set(F.struct("first", "end", "item_id"))).alias("spans")
    )
    ends = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["first"], s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")))
    none = F.array().cast("array<string>")
    zero, no_spans = F.lit(0).cast("long"), F.array().cast("array<struct<first:long,end:long,item_id:string>>")
    joined = rows.join(spans.withColumn("n_hit", ends["n"]).withColumnRenamed("key", "_key"), "_key", "left")
    return joined.withColumn("n_words", F.coalesce(word_count, F.lit(0)).cast("long")).select(
        *(c for c in rows.columns if c != "_key"), "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("spans", no_spans).alias("spans"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, percent: int = 5, told_bytes: int = TOLD_BYTES) -> DataFrame:
    """`docs` (text, ...) with n_words, n_hit, item_ids, spans, n_items, items_sha256 and contaminated.

    Texts of no words or null have no windows, nor do such items; rows stay as often as
    they are repeated; equal items count by their item_id, of which null ones are
    dropped. Extra columns stay, but for those with the names of added ones. Empty tables give an empty or a clean result.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    items = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string"))
    items = items.where(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))  # others have no windows, however many they are
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length(F.col("item_id").cast("string")) + 16)).first()[0] or 0
    found = (_told if size <= told_bytes else _joined)(docs, items, window, gram)
    return (
        found.withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", F.sort_array("item_ids")), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    )


#: The rule in DuckDB's SQL.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
  unnest(CASE WHEN len(w) < 13 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) END) AS g
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
  FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
