"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

log P(token | history) = log P(class | history) + the steps down the class's tree + log P(token | leaf).
Every factor but the last is a softmax over sums of weights of hashed features of the
history: the last token, the last two, and the one before the last alone (a skip).

Classes come from counts. The TOLD most frequent training tokens, seen TOLD_LEAST times or
more, are dealt by rank into classes of SLOTS**levels members; a member's place in base SLOTS
is its path in the class's tree, and each leaf is one word. All other tokens, known or new,
are one more class whose tree goes by the digits of the token's hash, DEEPEST levels at most;
a leaf's words have their exact discounted share of it, and the discounts go to words that
training never saw. All probabilities sum to one over the vocabulary and one unknown word in each leaf.

Counts are exact and stay distributed. Only the told tokens, and sums by leaf, go to all
tasks, both of fixed size. Texts are encoded once, each by itself, and written; their other
tokens find their counts by a join on the token, of which only sums come back to the row.

Weights: a step of iterative scaling of the classes' features from their counts, then
gradient updates, each over all training rows. Every task updates from the same weights,
with the expectation drawn from the softmax; the changes are averaged by how often a task
saw the feature. The number of buckets grows with the cube root of the training tokens:
every task holds all weights, and tasks take more rows as these grow. Features that share
a bucket share weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovesift.llm import textops
from trovesift.llm.shared import discard, map_slices, materialize, most_frequent, slices

#: Children of a node; classes of told tokens by rank: (how many, levels); levels of the other tokens' tree at most.
SLOTS = 16
RANKED = ((10, 1), (3, 2), (2, 3), (2, 4))
DEEPEST = 4
TOLD = sum(n * SLOTS**k for n, k in RANKED)
#: Seldomer tokens are never told, so that the class of all others is met in training.
TOLD_LEAST = 4
CLASSES = sum(n for n, _ in RANKED) + 1
RARE = CLASSES - 1
#: Codes: ranks of told tokens; OTHER and the first 30 bits of the hash of others.
OTHER = 1 << 30
#: Buckets of a feature at least; tokens for each bucket in a training task at least.
BUCKETS, TOKENS_PER_BUCKET = 1 << 13, 256
#: Tokens counted at once; tokens in a batch of histories; in a step of updates or scores.
COUNTED, BATCH, STEP = 1 << 22, 1 << 18, 1 << 12
#: Of the classes' features in the scaling step: their shares, what the prior counts for, and the most that a weight gets.
SCALED, PRIOR, MOST_SCALED = (0.5, 0.5, 0.2), 8.0, 4.0
#: A bucket seen n times moves by rate / (n + DAMP) ** POWER.
DAMP, POWER = 20.0, 0.75
#: The model travels in so many pieces.
PIECES = 64
#: The told tokens are found by a table of their first bits.
PREFIX = np.uint64(46)
KEYS = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
END = np.uint64(0x9D5C0FB1E3A7426B)
LN10 = math.log(10)
NEVER = -1e4


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and one end, and n+1 bounds."""
    data, offsets = textops.text_bytes(texts)
    spans = textops.Spans(textops.lower_ascii(data), offsets, textops.NON_SPACE)
    words = textops.span_hashes(spans.data, spans.start, spans.end)
    bounds = spans.first + np.arange(len(offsets))
    out = np.full(bounds[-1], END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = words
    return out, bounds


def buckets_for(tokens: int) -> int:
    """Buckets of a feature for a number of training tokens: a power of two of about 32 times its cube root."""
    return max(BUCKETS, 1 << math.ceil(math.log2(32 * max(1, tokens) ** (1 / 3))))


@dataclass
class Vocabulary:
    """told: hashes of the most frequent training tokens by rank, with counts; mass and types of the others by leaf; how many tokens and types."""

    told: np.ndarray
    counts: np.ndarray
    mass: np.ndarray
    types: np.ndarray
    tokens: int
    distinct: int
    discount: float
    order: np.ndarray = field(init=False)
    ranked: np.ndarray = field(init=False)
    head: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order = np.argsort(self.told).astype(np.int32)
        self.ranked = np.append(self.told[order], np.uint64(textops.MASK))
        self.order = np.append(order, np.int32(OTHER))
        self.head = np.searchsorted(self.ranked, np.arange(1 << int(64 - PREFIX)).astype(np.uint64) << PREFIX).astype(np.int32)
        others = int(self.types.sum())
        self.levels = next((k for k in range(DEEPEST) if SLOTS ** (k + 1) >= others), DEEPEST)
        each = len(self.mass) // SLOTS**self.levels
        self.mass, self.types = (x.reshape(-1, each).sum(1).astype(float) for x in (self.mass, self.types))
        self.weight = self.mass + 0.1  # an empty leaf has the unknown word alone
        self.unknown = np.log10(self.discount * self.types + 0.1)
        self.base = np.log10((self.counts + 0.1) / self.denominator)

    @property
    def denominator(self) -> float:
        """Of the base's shares."""
        return self.tokens + 0.1 * (self.distinct + 1)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        out = (hashes >> np.uint64(34)).astype(np.int32) | np.int32(OTHER)
        rows, at = np.arange(len(hashes)), self.head[(hashes >> PREFIX).astype(np.int64)]
        own = hashes
        while len(rows):  # along the told tokens with the same first bits
            here = self.ranked[at]
            hit = np.flatnonzero(here == own)
            out[rows[hit]] = self.order[at[hit]]
            on = np.flatnonzero(here < own)
            rows, at, own = rows[on], at[on] + 1, own[on]
        return out

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        """Leaves of others' codes."""
        return (codes & (OTHER - 1)) >> (30 - 4 * self.levels)


class Layout:
    """The classes' trees: for each class its first rank, levels, and the first node of each level; `slots` has the log shares of all nodes' children."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        levels = [k for n, k in RANKED for _ in range(n)] + [vocabulary.levels]
        self.levels = np.array(levels)
        sizes = SLOTS ** self.levels
        self.first = np.concatenate([[0], np.cumsum(sizes[:-1])])
        self.class_of_rank = np.repeat(np.arange(RARE), sizes[:-1]).astype(np.int8)
        counts = np.zeros(TOLD)
        counts[: len(vocabulary.counts)] = vocabulary.counts
        self.node = np.zeros((CLASSES, DEEPEST), np.int64)
        rows, at, share = [], 0, np.zeros(CLASSES)
        for c in range(CLASSES):
            own = vocabulary.weight if c == RARE else counts[self.first[c] : self.first[c] + sizes[c]]
            share[c] = own.sum()
            for level in range(self.levels[c]):
                self.node[c, level] = at
                rows.append(own.reshape(SLOTS ** (level + 1), -1).sum(1).reshape(-1, SLOTS))
                at += len(rows[-1])
        children = np.concatenate(rows) if rows else np.ones((1, SLOTS))
        with np.errstate(divide="ignore", invalid="ignore"):
            slots = np.log(children / children.sum(1, keepdims=True))
            bias = np.log(share / share.sum())
        self.slots = np.ascontiguousarray(np.nan_to_num(slots, nan=NEVER, neginf=NEVER).astype(np.float32))
        self.bias = np.maximum(bias, NEVER).astype(np.float32)

    def kinds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of tokens, and their places in them."""
        other = codes >= OTHER
        rank = np.where(other, 0, codes)
        kind = np.where(other, RARE, self.class_of_rank[rank]).astype(np.int64)
        place = np.where(other, (codes & (OTHER - 1)) >> (30 - 4 * int(self.levels[RARE])), rank - self.first[kind])
        return kind, place

    def steps(self, kind: np.ndarray, place: np.ndarray):
        """For each level the tokens that have it, their nodes, and the children taken."""
        depth = self.levels[kind]
        for level in range(int(depth.max(initial=0))):
            rows = np.flatnonzero(depth > level)
            below = 4 * (depth[rows] - 1 - level)
            path = place[rows] >> below
            yield rows, self.node[kind[rows], level] + (path >> 4), path & (SLOTS - 1)


def histories(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before, and the one before that; -1 beyond a text's begin."""
    one = np.empty_like(codes)
    one[1:], one[starts] = codes[:-1], -1
    two = np.empty_like(codes)
    two[1:], two[starts] = one[:-1], -1
    return one, two


@dataclass
class MaxEnt:
    """upper: weights of classes for the last token, the last two and the skip; lower: of children, for the last token and the skip with the node."""

    layout: Layout
    upper: list[np.ndarray]
    lower: list[np.ndarray]

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> MaxEnt:
        n = buckets_for(vocabulary.tokens)
        return cls(Layout(vocabulary), [np.zeros((b, CLASSES), np.float32) for b in (n, n, n // 4)], [np.zeros((b, SLOTS), np.float32) for b in (2 * n, n // 2)])

    @property
    def tables(self) -> list[np.ndarray]:
        return [*self.upper, *self.lower]

    def copy(self) -> MaxEnt:
        return MaxEnt(self.layout, [x.copy() for x in self.upper], [x.copy() for x in self.lower])

    def factors(self, codes: np.ndarray, one: np.ndarray, two: np.ndarray):
        """The softmaxes of some tokens: (tokens or None for all, nodes or None, children taken, [(table number, buckets)])."""
        shift = [np.uint64(65 - len(t).bit_length()) for t in self.tables]
        kind, place = self.layout.kinds(codes)
        last, skip = one.astype(np.uint64) * KEYS[0], two.astype(np.uint64) * KEYS[1]
        yield None, None, kind, [(0, _bucket(last, shift[0])), (1, _bucket(last ^ skip, shift[1])), (2, _bucket(skip, shift[2]))]
        for level, (rows, node, child) in enumerate(self.layout.steps(kind, place)):
            key = node.astype(np.uint64) * KEYS[2]
            ids = [(3, _bucket(last[rows] + key, shift[3]))]
            if not level:  # deeper nodes are seldom: what the skip tells is in the first
                ids.append((4, _bucket(skip[rows] + key, shift[4])))
            yield rows, node, child, ids

    def _logits(self, n: int, node: np.ndarray | None, ids, room) -> np.ndarray:
        width = CLASSES if node is None else SLOTS
        out, more = (x[: n * width].reshape(n, width) for x in room[:2])
        if node is None:
            out[:] = self.layout.bias
        else:
            np.take(self.layout.slots, node, axis=0, out=out, mode="clip")
        tables = self.tables
        for k, b in ids:
            out += np.take(tables[k], b, axis=0, out=more, mode="clip")
        return out

    def log10(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of each token's probability, but for the share of its leaf that a token of the last class has."""
        one, two = histories(codes, starts)
        total, room = np.zeros(len(codes)), _room()
        for a in range(0, len(codes), STEP):
            part = slice(a, a + STEP)
            for rows, node, child, ids in self.factors(codes[part], one[part], two[part]):
                n = len(child)
                if not n:
                    continue
                logits = self._logits(n, node, ids, room)
                width = logits.shape[1]
                own = logits.ravel().take(np.arange(0, n * width, width) + child)
                np.exp(logits, out=logits)
                own -= np.log(logits @ np.ones(width, np.float32))
                if rows is None:
                    total[part] += own
                else:
                    total[a + rows] += own
        return total / LN10

    def observe(self, codes: np.ndarray, starts: np.ndarray, seen: list[np.ndarray]) -> None:
        """Add up how often each bucket met each class."""
        one, two = histories(codes, starts)
        for a in range(0, len(codes), BATCH):
            part = slice(a, a + BATCH)
            _, _, child, ids = next(iter(self.factors(codes[part], one[part], two[part])))
            for k, b in ids:
                np.add.at(seen[k].ravel(), b * seen[k].shape[1] + child, 1.0)

    def update(self, codes: np.ndarray, starts: np.ndarray, rate: float, seen: list[np.ndarray], rng: np.random.Generator) -> None:
        """Gradient steps: up for the outcome, down for one drawn from the softmax, which is the gradient in expectation."""
        one, two = histories(codes, starts)
        room, tables = _room(), self.tables
        below = {w: np.triu(np.ones((w, w), np.float32)) for w in (CLASSES, SLOTS)}
        for a in range(0, len(codes), STEP):
            part = slice(a, a + STEP)
            for _, node, child, ids in self.factors(codes[part], one[part], two[part]):
                n = len(child)
                if not n:
                    continue
                p = self._logits(n, node, ids, room)
                width = p.shape[1]
                np.exp(p, out=p)
                up = np.matmul(p, below[width], out=room[1][: n * width].reshape(n, width))
                goal = up[:, -1] * rng.random(n, np.float32)
                drawn = (np.less(up, goal[:, None], out=p) @ np.ones(width, np.float32)).astype(np.int64)
                for k, b in ids:
                    count = seen[k]
                    np.add.at(count, b, 1.0)
                    step = (rate / len(ids) / (count[b] + DAMP) ** POWER).astype(np.float32)
                    flat, place = tables[k].ravel(), b * width
                    np.add.at(flat, place + child, step)
                    np.add.at(flat, place + np.minimum(drawn, width - 1), -step)


def _bucket(x: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (textops.mix(x) >> shift).astype(np.int64)


def _room() -> tuple[np.ndarray, np.ndarray]:
    size = STEP * max(CLASSES, SLOTS)
    return np.empty(size, np.float32), np.empty(size, np.float32)


def _code_batches(batches, column: int):
    """(codes, starts, first row, last row + 1, batch): whole texts of about BATCH tokens at once."""
    for batch in batches:
        lists = batch.column(column)
        bounds, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + BATCH, "right")) - 1)
            yield values[bounds[row] : bounds[last]], bounds[row:last] - bounds[row], row, last, batch
            row = last


def _gathered(rows: DataFrame, shapes: list[tuple], work: Callable) -> list[np.ndarray]:
    """Sums over all tasks of the arrays (of `shapes`) that `work(batches)` gives in each; they travel in PIECES pieces."""
    total = sum(math.prod(x) for x in shapes)
    size = -(-total // PIECES)
    as_batch = lambda ids, values: pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(values, pa.binary())], ["piece", "sums"])

    def one(batches):
        flat = np.concatenate([x.astype(np.float32).ravel() for x in work(batches)])
        for k in range(PIECES):
            part = flat[k * size : (k + 1) * size]
            if part.any():
                yield as_batch([k], [part.tobytes()])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(part.as_buffer(), np.float32)
                sums[k] = sums[k] + own if k in sums else own.astype(np.float64)
        for k, own in sums.items():
            yield as_batch([k], [own.astype(np.float32).tobytes()])

    schema = "piece int, sums binary"
    found = rows.mapInArrow(one, schema).repartition("piece").mapInArrow(add, schema).toArrow()  # PIECES rows, together as large as the model
    flat = np.zeros(PIECES * size, np.float32)
    for k, part in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        own = np.frombuffer(part.as_buffer(), np.float32)
        flat[k * size : k * size + len(own)] = own
    cuts = np.cumsum([0, *(math.prod(x) for x in shapes)])
    return [flat[a:b].reshape(x) for a, b, x in zip(cuts[:-1], cuts[1:], shapes, strict=True)]


def scaled(model: MaxEnt, seen: list[np.ndarray]) -> MaxEnt:
    """One step of iterative scaling: each class weight of a bucket by its share of the log ratio of observed to expected."""
    out, share = model.copy(), np.exp(model.layout.bias.astype(float))
    for table, met, part in zip(out.upper, seen, SCALED, strict=True):
        ratio = (met + PRIOR * share) / np.maximum((met.sum(1, keepdims=True) + PRIOR) * share, 1e-300)
        table += (part * np.clip(np.log(np.maximum(ratio, 1e-9)), -MOST_SCALED, MOST_SCALED)).astype(np.float32)
    return out


def train(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = 1, rate: float = 0.7) -> MaxEnt:
    """Weights from all rows of `encoded` (codes): a scaling step over them, then `rounds` of gradient updates, each over them all."""
    context = encoded.sparkSession.sparkContext
    model = MaxEnt.start(vocabulary)
    tasks = max(context.defaultParallelism, vocabulary.tokens // (TOKENS_PER_BUCKET * len(model.upper[0])))
    rows = encoded.select("codes").coalesce(tasks)
    told = context.broadcast(model)

    def count(batches):
        own = told.value
        seen = [np.zeros(x.shape) for x in own.upper]
        for codes, starts, _, _, _ in _code_batches(batches, 0):
            own.observe(codes, starts, seen)
        return seen

    model = scaled(model, _gathered(rows, [x.shape for x in model.upper], count))
    told.unpersist()
    for k in range(rounds):
        told = context.broadcast(model)

        def descend(batches, told=told, k=k):
            task = TaskContext.get()
            rng = np.random.default_rng((k, task.partitionId() if task else 0))
            own = told.value.copy()
            seen = [np.zeros(len(x)) for x in own.tables]
            for codes, starts, _, _, _ in _code_batches(batches, 0):
                own.update(codes, starts, rate, seen, rng)
            return [*((new - old) * n[:, None] for new, old, n in zip(own.tables, told.value.tables, seen, strict=True)), *seen]

        tables = model.tables
        sums = _gathered(rows, [*(x.shape for x in tables), *((len(x),) for x in tables)], descend)
        model = model.copy()
        for table, moved, n in zip(model.tables, sums, sums[len(tables) :], strict=False):
            table += moved / np.maximum(n, 1)[:, None]
        told.unpersist()
    return model


def _counts(batches):
    """(token, c) of the texts' tokens, counted COUNTED at a time."""
    parts, held = [], 0

    def flush():
        tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], ["token", "c"])

    for batch in batches:
        for piece in slices(batch):
            parts.append(token_hashes(piece.column(0))[0])
            held += len(parts[-1])
            if held >= COUNTED:
                yield flush()
                parts, held = [], 0
    if held:
        yield flush()


def count_tokens(docs: DataFrame, told: int = TOLD) -> tuple[DataFrame, Vocabulary]:
    """All training tokens (token, total), written; and what all tasks are told of them."""
    spark = docs.sparkSession
    counts = materialize(docs.select("text").mapInArrow(_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("total")), "counts")
    most = np.array(most_frequent(counts.where(F.col("total") >= TOLD_LEAST), "token", "total", told), np.int64).reshape(-1, 2)
    tokens, times = np.ascontiguousarray(most[:, 0]), np.ascontiguousarray(most[:, 1])
    rest = F.col("total") < TOLD_LEAST
    if len(most) == told:  # the order of the told ones: by count, then by token
        rest = rest | (F.col("total") < int(times[-1])) | ((F.col("total") == int(times[-1])) & (F.col("token") > int(tokens[-1])))
    others = counts.where(rest)
    bits = 4 * DEEPEST
    leaves = others.groupBy(F.shiftrightunsigned("token", 64 - bits).cast("int").alias("leaf")).agg(F.sum("total").alias("mass"), F.count("*").alias("types")).toArrow()  # SLOTS**DEEPEST rows at most
    mass, types = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    at = leaves.column("leaf").to_numpy()
    mass[at], types[at] = leaves.column("mass").to_numpy(), leaves.column("types").to_numpy()
    ones, twos = counts.agg(F.count_if(F.col("total") == 1), F.count_if(F.col("total") == 2)).first()
    discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1  # of absolute discounting (Ney et al., 1994)
    vocabulary = Vocabulary(tokens.view(np.uint64), times, mass, types, int(times.sum() + mass.sum()), len(most) + int(types.sum()), discount)
    return counts, vocabulary


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(key, doc_id, held_out, n_tokens, n_known, base_score, fixed, codes, others) of each row; the sums are those of told tokens, `others` are the rest with how often."""
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)
    other_kind = pa.struct([("token", pa.int64()), ("m", pa.int32()), ("unseen", pa.float64())])

    def function(batch):
        own: Vocabulary = told.value
        hashes, bounds = token_hashes(batch.column(2))
        codes = own.codes(hashes)
        known = codes < OTHER
        base = np.zeros(len(codes))
        base[known] = own.base[codes[known]]
        sums = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  each text has its end at least
        rest = np.flatnonzero(~known)
        fixed = np.zeros(len(codes))
        fixed[rest] = -np.log10(own.weight[own.leaf(codes[rest])])
        of = np.searchsorted(bounds, rest, "right") - 1
        order = np.lexsort((hashes[rest], of))
        rest, of = rest[order], of[order]
        values = hashes[rest]
        new = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (of[1:] != of[:-1])])) if len(rest) else rest
        times = np.diff(np.append(new, len(rest)))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=batch.num_rows))])
        others = pa.StructArray.from_arrays([pa.array(values[new].view(np.int64)), pa.array(times, pa.int32()), pa.array(own.unknown[own.leaf(codes[rest[new]])])], fields=list(other_kind))
        columns = [
            batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(bounds)), pa.array(sums(known.astype(np.int64))), pa.array(sums(base)), pa.array(sums(fixed)),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(codes)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), others),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "fixed", "codes", "others"])

    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, fixed double, codes array<int>, others array<struct<token:long,m:int,unseen:double>>"
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", "held_out")  # keys are written with the rows, so they stay
    return materialize(map_slices(keyed, function, schema), "encoded")


def score_documents(docs: DataFrame, held_out: str = "held_out", rounds: int = 1, told: int = TOLD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of `docs` (doc_id, text, held_out).

    Learns from rows that are not held out; `told` is how many tokens are told at most (TOLD). Null texts are empty: they have the end as
    their only token. Repeated rows count and are scored as often as they occur; other
    columns are ignored; an empty table gives an empty result. Without training rows
    every token is unknown, and both scores are 0. A text is held whole, with some twenty
    bytes for each of its tokens; softmaxes take STEP tokens at a time, whatever its length.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    counts, vocabulary = count_tokens(docs.where(~F.col("held_out")), told)
    encoded = encode(docs, vocabulary)
    model = docs.sparkSession.sparkContext.broadcast(train(encoded.where(~F.col("held_out")), vocabulary, rounds))
    names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def score(batches):
        for codes, starts, row, last, batch in _code_batches(batches, 7):
            piece = batch.slice(row, last - row)
            sums = np.add.reduceat(model.value.log10(codes, starts), starts) + piece.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([*piece.columns[:6], pa.array(sums)], names)

    scored = encoded.drop("others").mapInArrow(score, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    others = encoded.select("key", F.inline("others")).join(counts, "token", "left")
    seen = F.col("total").isNotNull()
    base = F.log10((F.coalesce("total", F.lit(0)) + 0.1) / F.lit(vocabulary.denominator))
    share = F.when(seen, F.log10(F.col("total") - vocabulary.discount)).otherwise(F.col("unseen"))
    sums = others.groupBy("key").agg(F.sum(F.when(seen, F.col("m")).otherwise(0)).alias("known"), F.sum(F.col("m") * base).alias("base"), F.sum(F.col("m") * share).alias("share"))
    whole = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    out = scored.join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", whole("n_known", "known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), whole("base_score", "base"), whole("score", "share")
    )
    out = materialize(out, "scores")
    for used in (encoded, counts):
        discard(used)
    return out
