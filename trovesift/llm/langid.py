"""Language identification: family first, then one-versus-one linear SVMs within the family.

Features are relative frequencies of hashed byte n-grams (1 to 4) of the letters of the
whole text; words are set apart by one space each. One-versus-rest SVMs choose the
family, and one-versus-one SVMs separate its languages. A linear score of frequencies
is a mean of n-gram weights, so a text is scored by one gather and one sum per model,
whatever its length, without any array per document.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovesift.llm import textops
from trovesift.llm.shared import map_beside, release

# Language families by ISO 639-1 code; a language not named is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
UNKNOWN = "und"
DIMENSIONS = 1 << 13
GRAMS = (1, 2, 3, 4)
#: So many languages may be broadcast with how far their samples reach; beyond it they are joined by a shuffle.
TOLD_LANGUAGES = 100_000
LETTER = re.compile(r"[^\W\d_]")

# Letters of ASCII in lower case and all bytes beyond it stay; the rest is space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), f"only-{language}")


def features(texts: pa.Array):
    """For each n in GRAMS the n-gram buckets at all places, then document bounds in these arrays.

    Each text becomes one space, its folded bytes, four spaces. An n-gram that begins with
    two spaces, or spans from one text into the next, falls into bucket 0, which is void.
    """
    data, offsets = textops.text_bytes(texts)
    count = len(offsets) - 1
    body = np.full(len(data) + 5 * count + 4, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(5 * np.arange(count) + 1, np.diff(offsets))
    body[place] = _FOLD[data]
    starts = offsets[:-1] + 5 * np.arange(count)
    size = len(body) - 4
    wide = body.astype(np.uint64)
    void = (body[:size] == 32) & (body[1 : size + 1] == 32)
    code = np.zeros(size, np.uint64)
    out = []
    for k in GRAMS:
        code = code * np.uint64(257) + wide[k - 1 : k - 1 + size] + np.uint64(1)
        bucket = np.maximum(textops.mix(code * np.uint64(8) + np.uint64(k)) >> np.uint64(65 - DIMENSIONS.bit_length()), 1).astype(np.int32)
        bucket[void] = 0
        out.append(bucket)
    return out, starts, size


@dataclass
class LanguageModel:
    """weights: (DIMENSIONS, models) of scaled features; the first len(families) models choose the family, the rest are `pairs`."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray

    def margins(self, texts: pa.Array) -> np.ndarray:
        grams, starts, size = features(texts)
        if not len(starts):
            return np.zeros((0, len(self.bias)))
        used = sum(np.add.reduceat((g > 0).astype(np.int32), starts) for g in grams)
        total = np.zeros((len(starts), len(self.bias)))
        for m in range(len(self.bias)):
            own = np.ascontiguousarray(self.weights[:, m])
            place = np.zeros(size, np.float32)
            for g in grams:
                place += own[g]
            total[:, m] = np.add.reduceat(place.astype(np.float64), starts)
        return total / np.maximum(used, 1)[:, None] + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text, and a score from 0 to 1."""
        count = len(texts)
        lettered = np.array([bool(x) and LETTER.search(x) is not None for x in texts.to_pylist()], bool)
        if not self.languages:
            return [UNKNOWN] * count, np.zeros(count)
        margins = self.margins(texts)
        chance = 1 / (1 + np.exp(-np.clip(self.slope * margins, -30, 30)))
        families = chance[:, : len(self.families)]
        families = families / np.maximum(families.sum(1, keepdims=True), 1e-300)
        best = families.argmax(1) if len(self.families) > 1 else np.zeros(count, int)
        labels, scores = np.empty(count, object), np.zeros(count)
        for f, family in enumerate(self.families):
            rows = best == f
            members = [x for x in self.languages if family_of(x) == family]
            votes, against = np.zeros((count, len(members))), np.zeros((count, len(members)))
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    p = chance[:, len(self.families) + k]
                    votes[:, members.index(a)] += p
                    votes[:, members.index(b)] += 1 - p
                    odds = np.maximum(p, 1e-12) / np.maximum(1 - p, 1e-12)
                    against[:, members.index(a)] += 1 / odds
                    against[:, members.index(b)] += odds
            # Pairwise coupling (Price et al., 1995): odds against a member add up; for two members it is the pair's own chance.
            coupled = 1 / (1 + against)
            coupled /= coupled.sum(1, keepdims=True)
            pick = votes.argmax(1)
            labels[rows] = np.array(members, object)[pick[rows]]
            scores[rows] = (families[:, f] * coupled[np.arange(count), pick])[rows]
        labels[~lettered], scores[~lettered] = UNKNOWN, 0.0
        return labels.tolist(), np.clip(scores, 0, 1)


def _svm(x: np.ndarray, pool: np.ndarray, y: np.ndarray, seed: int, epochs: int = 12, regular: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Pegasos with averaging (Shalev-Shwartz et al., 2007), classes weighted to be equal, on the rows `pool` of x; then the slope of a logistic fit of its margins."""
    rng = np.random.default_rng(seed)
    n, d = len(pool), x.shape[1]
    w, b, mean_w, mean_b, t, kept = np.zeros(d, np.float32), 0.0, np.zeros(d), 0.0, 0, 0
    weight = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y < 0).sum()))
    size = 64
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, size):
            rows = order[at : at + size]
            own = x[pool[rows]].astype(np.float32)
            t += 1
            rate = 1 / (regular * (t + 1000))
            miss = y[rows] * (own @ w + b) < 1
            push = np.where(miss, y[rows] * weight[rows], 0).astype(np.float32)
            w = w * np.float32(1 - rate * regular) + np.float32(rate / len(rows)) * (push @ own)
            b += 0.01 * rate * float(push.mean())
            if epoch >= epochs // 2:
                mean_w += w
                mean_b += b
                kept += 1
    w, b = mean_w / max(1, kept), mean_b / max(1, kept)
    margins = np.concatenate([x[pool[k : k + size]].astype(np.float32) @ w + b for k in range(0, n, size)])
    slope = 1.0
    for _ in range(50):  # Newton on the log loss of sigmoid(slope * margin)
        p = 1 / (1 + np.exp(-np.clip(slope * margins, -30, 30)))
        slope -= float(np.clip(((p - (y > 0)) * margins).sum() / max(1e-9, (p * (1 - p) * margins**2).sum()), -2, 2))
        slope = min(max(slope, 0.5), 8.0)
    return w, b, slope


def train(rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """Fit on (text, language) rows; languages with no text are not learned."""
    rows = [(t, lang) for t, lang in rows if t and LETTER.search(t)]
    if not rows:
        return LanguageModel([], [], [], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), np.zeros(0))
    languages = sorted({lang for _, lang in rows})
    families = sorted({family_of(x) for x in languages})
    pairs = [p for f in families for p in combinations([x for x in languages if family_of(x) == f], 2)]
    x = np.zeros((len(rows), DIMENSIONS), np.float16)
    mean = np.zeros(DIMENSIONS)
    for i, (text, _) in enumerate(rows):
        grams, _, _ = features(pa.array([text]))
        counts = sum(np.bincount(g, minlength=DIMENSIONS) for g in grams)
        counts[0] = 0
        counts = counts / max(1, counts.sum())
        mean += counts / len(rows)
        x[i] = np.sqrt(counts)  # small shares keep their digits
    scale = (1 / np.sqrt(mean + 1e-5)).astype(np.float32)  # frequent n-grams don't drown the others
    scale[0] = 0
    for i in range(len(rows)):
        x[i] = x[i].astype(np.float32) ** 2 * scale
    lang = np.array([b for _, b in rows], object)
    family = np.array([family_of(b) for _, b in rows], object)
    fits = []
    if len(families) > 1:
        for k, f in enumerate(families):
            fits.append(_svm(x, np.arange(len(rows)), np.where(family == f, 1.0, -1.0), seed + k))
    elif families:
        fits.append((np.zeros(DIMENSIONS), 1.0, 8.0))
    for k, (a, b) in enumerate(pairs):
        pool = np.flatnonzero((lang == a) | (lang == b))
        fits.append(_svm(x, pool, np.where(lang[pool] == a, 1.0, -1.0), seed + 100 + k))
    weights = np.stack([w * scale for w, _, _ in fits], 1).astype(np.float32) if fits else np.zeros((DIMENSIONS, 0), np.float32)
    return LanguageModel(languages, families, pairs, weights, np.array([b for _, b, _ in fits]), np.array([s for _, _, s in fits]))


def labelled_sample(docs: DataFrame, per_language: int = 600) -> DataFrame:
    """(doc_id, lang, text): at most `per_language` labelled texts of each language, the first by a seeded hash of the doc_id, then by text; all of a rarer language.

    Null and repeated ids are rows like others, so a language with a label is never without a text.
    """
    order = F.xxhash64(F.lit("sample"), "doc_id")
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang", F.col("text").cast("string").alias("text"), order.alias("order"))
    # Hashes alone tell how far the sample reaches in each language, so texts beyond it are never sorted; salts keep a frequent language from one task.
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("order"))).where(F.col("rank") <= per_language)
    keys = labelled.select("lang", "order", F.pmod("order", F.lit(16)).alias("salt"))
    reach = first(first(keys, "lang", "salt"), "lang").groupBy("lang").agg(F.max("order").alias("reach"))
    few = reach.limit(TOLD_LANGUAGES + 1).toArrow()  # two numbers a language: told to tasks, so no text is shuffled by its language
    if few.num_rows <= TOLD_LANGUAGES:
        reach = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["reach"]) for r in few.to_pylist()], reach.schema))
    near = labelled.join(reach, "lang").where(F.col("order") <= F.col("reach"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "text")))
    return ranked.where(F.col("rank") <= per_language).select("doc_id", "lang", "text")


def fit(docs: DataFrame, per_language: int = 600) -> LanguageModel:
    """The model of a labelled sample of `docs` (doc_id, text, lang), trained in a task; only the model comes to the driver."""

    def run(batches):
        rows = sorted((r["doc_id"] is None, r["doc_id"], r["text"], r["lang"]) for batch in batches for r in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(text, lang) for _, _, text, lang in rows]))])], ["model"])
        del rows
        release()

    sample = labelled_sample(docs, per_language).repartition(1)
    found = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else train([])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` (text, ...) with lang_pred and score.

    Null texts, and texts without a letter, are ``und`` with score 0; so is all if the
    model learned nothing. Rows are scored alone: ties, repeated rows and extra columns
    don't matter (lang_pred and score are replaced), and an empty table gives an empty result.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def function(texts):
        labels, scores = told.value.predict(texts)
        return [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]

    return map_beside(docs.withColumn("text", F.col("text").cast("string")), function, "lang_pred string, score double")
