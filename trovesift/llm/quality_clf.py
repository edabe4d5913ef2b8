"""Quality classifier with supervised subword embeddings.

Joulin et al., "Bag of Tricks for Efficient Text Classification" (2017): each hashed
word, word pair and byte n-gram has a learned vector; a document is the mean of its
vectors, a softmax layer on it gives the class. Trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows. For scoring, the output layer is folded
into the vectors, so a whole text costs one gather and one sum per feature.

Digits are one sign and white space is one space; a pair of equal words is the same
feature for all words, so that stuttering is learned once.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovesift.llm import textops
from trovesift.llm.shared import map_beside, release

BUCKETS, WIDTH = 1 << 16, 12
GRAMS = (3, 4)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x30:0x3A] = 0x30
_FOLD[[*range(0x09, 0x0E)]] = 0x20


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(buckets, bounds)]: words, word pairs, and n-grams of each size; bounds[d]:bounds[d+1] are document d's. Bucket 0 is void."""
    data, offsets = textops.text_bytes(texts)
    data = _FOLD[data]
    spans = textops.Spans(data, offsets, textops.NON_SPACE)
    words = textops.span_hashes(data, spans.start, spans.end)
    shift = np.uint64(65 - BUCKETS.bit_length())
    bucket = lambda h: np.maximum(h >> shift, 1).astype(np.int32)
    out = [(bucket(textops.mix(words + np.uint64(1))), spans.first)]
    pairs = np.zeros(len(words), np.int32)
    if len(words) > 1:
        pairs[1:] = np.where(words[1:] == words[:-1], 1, bucket(textops.mix(words[1:] * np.uint64(textops.BASE) + words[:-1])))
        pairs[spans.first[:-1][spans.counts > 0]] = 0  # the first word of a text has none before it
    out.append((pairs, spans.first))
    wide = data.astype(np.uint64)
    n = len(data)
    for k in GRAMS:
        grams = np.zeros(n, np.int32)
        if n >= k:
            code = np.full(n - k + 1, k, np.uint64)
            for j in range(k):
                code = code * np.uint64(257) + wide[j : n - k + 1 + j]
            grams[: n - k + 1] = bucket(textops.mix(code))
        for back in range(1, k):  # n-grams that would reach into the next text
            at = offsets[1:] - back
            grams[at[at >= offsets[:-1]]] = 0
        out.append((grams, offsets))
    return out


@dataclass
class QualityModel:
    """weight[bucket] is the folded logit of class 1 against class 0."""

    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        total, used = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, bounds in features(texts):
            sums = np.concatenate([[0.0], np.cumsum(self.weight[buckets], dtype=np.float64)])
            seen = np.concatenate([[0], np.cumsum(buckets > 0)])
            total += sums[bounds[1:]] - sums[bounds[:-1]]
            used += seen[bounds[1:]] - seen[bounds[:-1]]
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(used, 1) + self.bias, -30, 30)))


def train(rows: list[tuple[str, int]], epochs: int = 8, rate: float = 0.5, seed: int = 11) -> QualityModel:
    """Fit on (text, label 0 or 1) rows; without rows every score is a half."""
    if not rows:
        return QualityModel(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    table = ((rng.random((BUCKETS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    table[0] = 0
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2)
    sparse = []
    for text, label in rows:
        ids, counts = np.unique(np.concatenate([b for b, _ in features(pa.array([text]))]), return_counts=True)
        ids, counts = ids[ids > 0], counts[ids > 0]
        sparse.append((ids, (counts / max(1, counts.sum())).astype(np.float32), int(label)))
    steps, done = epochs * len(sparse), 0
    for _ in range(epochs):
        for k in rng.permutation(len(sparse)).tolist():
            ids, share, label = sparse[k]
            now = rate * (1 - done / steps)
            done += 1
            mean = share @ table[ids]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = (layer @ p).astype(np.float32)
            layer -= (now * np.outer(mean, p)).astype(np.float32)
            bias -= 0.05 * now * p
            # Shares are small: a step of the size that a mean over few features would get.
            table[ids] -= np.outer(share * np.float32(now * min(len(ids), 400)), back)
    fold = table @ (layer[:, 1] - layer[:, 0])
    fold[0] = 0
    return QualityModel(fold.astype(np.float64), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = 3000) -> DataFrame:
    """(doc_id, text, quality): at most `most` labelled texts, the first by a seeded hash of the doc_id; all if there are fewer.

    A label that occurs more than once counts once, and so does the text of an id, the
    smallest, however often the id occurs; labels of null ids and other values are ignored.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct()
    chosen = known.orderBy(F.xxhash64(F.lit("quality sample"), "doc_id"), "doc_id", "quality").limit(most)
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").where("text is not null")
    return picked.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def fit(sample: DataFrame) -> QualityModel:
    """The model of a bounded sample (doc_id, text, quality), trained in a task; only the model comes to the driver."""

    def run(batches):
        rows = sorted((r["doc_id"], r["quality"], r["text"]) for batch in batches for r in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(text, label) for _, label, text in rows]))], pa.binary())], ["model"])
        release()

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else train([])


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """`docs` (text, ...) with score (0 to 1, higher: label 1 is likelier) and predicted (1 if score >= threshold).

    Null and empty texts have no features: their score is the bias alone. Rows are scored
    alone, so repeated rows score alike; columns of these names are replaced; an empty
    table gives an empty result.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    scored = map_beside(docs.withColumn("text", F.col("text").cast("string")), lambda texts: [pa.array(told.value.score(texts), pa.float64())], "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
