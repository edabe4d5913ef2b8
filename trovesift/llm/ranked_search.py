"""Ranked lexical search of many queries at once, by sort-based accumulation.

The texts are read once: tasks keep, for each document, the query terms it holds with
their counts, and its length. From these come the corpus's numbers (documents, terms,
document frequencies). Then each task, over a range of documents, concatenates the
(item, document, impact) arrays of all matched terms, radix sorts their packed keys, adds
equal keys up with reduceat, and selects each item's best with a heap; the lists of the
tasks meet in two steps, so no item's rows are in one task before they were cut.

All arithmetic but the logarithm is on 64-bit integers, so results don't depend on order.
Queries are taken in blocks of bounded size; what is broadcast is a block, never the table.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovesift.llm import textops
from trovesift.llm.shared import map_slices, materialize

#: Distinct (item, term) pairs of a block of queries; one item is never split.
BLOCK_PAIRS = 1 << 20
#: (item, document, impact) entries that a task holds at once; one document's are never split.
ENTRIES = 1 << 21
#: Lists of an item that meet first.
SALTS = 16
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _eight(data: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def terms_of(texts: pa.Array) -> textops.Spans:
    """Runs of ASCII letters and digits and of all beyond ASCII, A-Z lower-cased."""
    data, offsets = textops.text_bytes(texts)
    return textops.Spans(textops.lower_ascii(data), offsets, textops.ALNUM)


class Vocabulary:
    """The distinct terms of a block of queries: found by hash, then compared byte by byte."""

    def __init__(self, terms: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.end = np.cumsum([len(t) for t in terms], dtype=np.int64)
        self.start = self.end - np.array([len(t) for t in terms], np.int64)
        hashes = textops.span_hashes(self.data, self.start, self.end)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        # Equal hashes of different terms can't be told apart by a search; tiny odds, so refuse.
        if len(terms) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two query terms have one hash")
        bits = max(10, (4 * len(terms)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.hashes >> self.shift] = True

    def __len__(self) -> int:
        return len(self.end)

    def find(self, spans: textops.Spans) -> tuple[np.ndarray, np.ndarray]:
        """(place, term): which spans are terms, and which ones."""
        hashes = textops.span_hashes(spans.data, spans.start, spans.end)
        rows = np.flatnonzero(self.maybe[hashes >> self.shift])
        at = np.minimum(np.searchsorted(self.hashes, hashes[rows]), len(self) - 1)
        same = self.hashes[at] == hashes[rows]
        rows, term = rows[same], self.order[at[same]]
        size = spans.end[rows] - spans.start[rows]
        same = size == self.end[term] - self.start[term]
        rows, term, size = rows[same], term[same], size[same]
        ours, theirs = _eight(self.data), _eight(spans.data)
        same, left, k = np.ones(len(rows), bool), np.arange(len(rows)), 0
        while len(left):
            mask = _FIRST[np.minimum(size[left] - k, 8)]
            same[left] &= (theirs[spans.start[rows[left]] + k] & mask) == (ours[self.start[term[left]] + k] & mask)
            k += 8
            left = left[(size[left] > k) & same[left]]
        return rows[same], term[same]


def counted_terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term at all: their length in terms, and the vocabulary's terms in them with counts."""
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch):
        known = told.value
        spans = terms_of(batch.column(1))
        place, term = known.find(spans)
        doc = np.searchsorted(spans.first, place, side="right") - 1
        key, tf = np.unique(doc * len(known) + term, return_counts=True)
        doc, term = key // len(known), key % len(known)
        bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans.counts, pa.int64()), lists(term, pa.int32()), lists(tf, pa.int64())], ["doc_id", "n", "terms", "tfs"])
        return out.filter(pa.array(spans.counts > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Queries:
    """A block of items: for term t the items `item[first[t]:first[t+1]]` that ask for it, `times` often."""

    def __init__(self, items: list[list[int]], terms: int) -> None:
        pairs = np.array([(t, i) for i, own in enumerate(items) for t in own], np.int64).reshape(-1, 2)
        key, times = np.unique(pairs[:, 0] * max(1, len(items)) + pairs[:, 1], return_counts=True)
        self.item, self.times = key % max(1, len(items)), times.astype(np.int64)
        self.first = np.searchsorted(key // max(1, len(items)), np.arange(terms + 1))
        self.count = len(items)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, by 16-bit digits from the low to the high one; a digit that is in order already costs no pass."""
    order = None
    for digit in range((int(keys.max()).bit_length() + 15) // 16 if len(keys) else 0):
        values = ((keys if order is None else keys[order]) >> np.uint64(16 * digit)).astype(np.uint16)
        if (values[1:] < values[:-1]).any():
            step = np.argsort(values, kind="stable")  # a radix sort for 16-bit integers
            order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


def accumulate(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score): impacts of (doc, term) matches, dealt to the items that ask for the term and added up."""
    size = queries.first[term + 1] - queries.first[term]
    total = int(size.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3
    place = np.repeat(queries.first[term] - (np.cumsum(size) - size), size) + np.arange(total)
    low = 16 * max(1, (int(doc.max()).bit_length() + 15) // 16)  # whole digits: documents come in order, so theirs cost nothing
    keys = (queries.item[place].astype(np.uint64) << np.uint64(low)) | np.repeat(doc, size).astype(np.uint64)
    values = np.repeat(impact, size) * queries.times[place]
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    score = np.add.reduceat(values[order], first)
    return (keys[first] >> np.uint64(low)).astype(np.int64), (keys[first] & np.uint64((1 << low) - 1)).astype(np.int64), score


class Best:
    """The best documents of each item so far: highest score first, then the smallest doc_id, null before all."""

    def __init__(self, count: int, most: int) -> None:
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        self.least = np.ones(count, np.int64)  # the score that a full heap asks for
        self.most = most

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, keys: list[int]) -> None:
        """Scores of (item, doc); keys[doc] is its doc_id."""
        for k in np.flatnonzero(score >= self.least[item]).tolist():
            i, entry = int(item[k]), (int(score[k]), -keys[doc[k]])
            heap = self.heaps[i]
            if len(heap) < self.most:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.most:
                self.least[i] = heap[0][0]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(i, -key, score) for i, heap in enumerate(self.heaps) for score, key in heap]


#: Stands for a null doc_id: before every number.
NULL_KEY = -(1 << 63) - 1


def _top_of_tasks(matched: DataFrame, queries: Queries, weights: np.ndarray, n_all: int, l_all: int, most: int) -> DataFrame:
    """(no, doc_id, score): each task's best documents of each item."""
    told = matched.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = told.value
        best = Best(queries.count, most)
        breadth = queries.first[1:] - queries.first[:-1]
        for batch in batches:
            ids, n, terms, tfs = batch.columns
            keys = [NULL_KEY if x is None else x for x in ids.to_pylist()]
            bounds = terms.offsets.to_numpy().astype(np.int64)
            term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
            bounds = bounds - bounds[0]
            longest = int(n.to_numpy().max(initial=0))
            if 25 * longest * n_all < 1 << 62:
                m = 75 + (25 * n.to_numpy() * n_all) // l_all
            else:
                m = np.array([min(75 + (25 * x * n_all) // l_all, 1 << 58) for x in n.to_pylist()], np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            entries = np.concatenate([[0], np.cumsum(breadth[term])])[bounds]
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(entries, entries[at] + ENTRIES, side="right")) - 1)
                some = slice(int(bounds[at]), int(bounds[stop]))
                best.add(*accumulate(doc[some] - at, term[some], impact[some], queries), keys[at:stop])
                at = stop
        rows = best.rows()
        if rows:
            no, key, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array([None if x == NULL_KEY else x for x in key], pa.int64()), pa.array(score, pa.int64())], ["no", "doc_id", "score"])

    return matched.mapInArrow(run, "no int, doc_id long, score long")


def _merged(tops: DataFrame, most: int) -> DataFrame:
    """(no, rank, doc_id, score): lists of the same salt meet first, so that an item's task reads SALTS lists, not one from every task."""
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    salted = tops.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(order("no", "_salt"))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(order("no"))).where(F.col("rank") <= most).select("no", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` documents (doc_id, text) with the highest positive scores for each item (item_id, text).

    Every row of `items` is a query of its own, also where an item_id is null or repeated
    (its rows come out once for each); every row of `docs` is a document. Null texts and
    texts without a term match nothing; items without a match give no rows; equal scores
    go by doc_id, null first, and equal rows stay apart by rank. Empty tables give an empty
    result; extra columns are ignored. An item's distinct terms are held whole by a task.
    """
    spark = docs.sparkSession
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # Words bound an item's distinct terms; blocks by a hash of the row are about equal, whatever the table's order.
    words = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2 + 1
    blocks = -(-words // BLOCK_PAIRS)
    out = None
    for block in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = _ranked_block(docs, own.toArrow(), most)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    schema = items.select("item_id").schema["item_id"].dataType.simpleString()
    return out if out is not None else spark.createDataFrame([], f"item_id {schema}, rank int, doc_id long, score long")


def _ranked_block(docs: DataFrame, block: pa.Table, most: int) -> DataFrame | None:
    spark = docs.sparkSession
    texts = block.column("text").combine_chunks()
    if not len(texts):
        return None
    spans = terms_of(texts)
    raw = spans.data.tobytes()
    numbers: dict[bytes, int] = {}
    asked = [[numbers.setdefault(raw[spans.start[k] : spans.end[k]], len(numbers)) for k in range(spans.first[i], spans.first[i + 1])] for i in range(len(texts))]
    if not numbers:
        return None
    matched = materialize(counted_terms(docs, Vocabulary(list(numbers))), "matched")
    total = matched.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    if not total.n:
        return None
    frequency = {r.t: r.df for r in matched.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    weights = np.array([weight(total.n, frequency.get(t, 0)) for t in range(len(numbers))], np.int64)
    best = _merged(_top_of_tasks(matched, Queries(asked, len(numbers)), weights, total.n, total.l, most), most)
    kind = spark.createDataFrame([], "no int").schema
    names = spark.createDataFrame([(i, x) for i, x in enumerate(block.column("item_id").to_pylist())], kind.add("item_id", _type(block.column("item_id").type)))
    return best.join(F.broadcast(names), "no").select("item_id", "rank", "doc_id", "score")


def _type(kind: pa.DataType):
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
corpus AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM docs),
tfs AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY doc_id, n, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * n_all + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN dfs USING (term), corpus GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""
