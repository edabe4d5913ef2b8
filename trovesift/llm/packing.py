"""Best-fit packing of token pieces into sequences by bin completion, a branch and bound.

Korf, "A New Algorithm for Optimal Bin Packing" (2002). Pieces of one length are alike,
so the search works on the counts of lengths, of which there are at most `capacity`,
whatever the size of the corpus. A best-fit packing is the first incumbent; the search
fills the sequence around the largest piece left by undominated fillings, least waste
first, each as often as its lengths last, and prunes by bounds on waste. It ends once the
incumbent meets the bound, or after `dives` ways down; the incumbent is always a whole
packing. The pieces are then numbered within their length, in buckets, and find their
place by a join with the plan, which has some thousand rows at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovesift.llm.shared import map_slices, materialize
from trovesift.llm.tokens import BpeEncoder

#: A filling is [(length, how many), ...], longest first.
Filling = list[tuple[int, int]]
#: Rows of one length that are numbered in one group.
NUMBERED = 20_000


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on counts of lengths: fillings with how often each is used."""
    open_: dict[int, list[list]] = {}  # room left: [filling, bins]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                most = capacity // length
                for k in (most, left % most):
                    bins = left // most if k == most else 1
                    if k and bins and left >= k * bins:
                        open_.setdefault(capacity - k * length, []).append([[(length, k)], bins])
                        left -= k * bins
                continue
            filling, bins = open_[room].pop()
            most = min(room // length, left)
            used = min(bins, left // most)
            if used < bins:
                open_[room].append([filling, bins - used])
            elif not open_[room]:
                del open_[room]
            open_.setdefault(room - most * length, []).append([[*filling, (length, most)], used])
            left -= most * used
    return [(filling, bins) for rows in open_.values() for filling, bins in rows]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on bins, L2 of Martello and Toth (1990): no two pieces above half share a bin, and none of at least `a` goes beside one above capacity - a."""
    number, total = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        number[length], total[length] = n, n * length
    number, total = np.cumsum(number), np.cumsum(total)
    half = capacity // 2
    a = np.arange(half + 1)
    below = np.maximum(a - 1, 0)
    alone, large = number[capacity] - number[capacity - a], number[capacity - a] - number[half]
    beside = total[half] - np.where(a > 0, total[below], 0)
    spare = large * capacity - (total[capacity - a] - total[half])
    return int((alone + large + np.maximum(0, -(-(beside - spare) // capacity))).max())


def dominated(filling: Filling, counts: dict[int, int], waste: int) -> bool:
    """Whether a piece that is left fits beside the filling's pieces, or in place of one or more of them (but the largest)."""
    free = 0
    for x, n in counts.items():
        if n > sum(m for y, m in filling if y == x):
            free |= 1 << x
    if free & ((1 << (waste + 1)) - 1):
        return True
    one = many = 0  # sums of one piece or more, and of two or more
    for k, (x, n) in enumerate(filling):
        for _ in range(n - (k == 0)):
            many |= (many | one) << x
            one |= (one << x) | (1 << x)
    if any((many << d) & free for d in range(waste + 1)):
        return True
    return any((free >> (x + 1)) & ((1 << waste) - 1) for k, (x, n) in enumerate(filling) if n > (k == 0))


def fillings(counts: dict[int, int], capacity: int, looks: int = 48) -> Iterator[Filling]:
    """Undominated fillings around the largest piece, least waste first, and those of longer pieces first among equals.

    Sums that can be reached from each length on are kept as bits of a number, so no
    branch is entered that ends elsewhere. So many fillings are looked at; if all of them
    are dominated, the first is given.
    """
    lengths = sorted((x for x in counts if counts[x]), reverse=True)
    first = lengths[0]
    room = capacity - first
    usable = [(x, min(counts[x] - (x == first), room // x)) for x in lengths if x <= room]
    usable = [(x, n) for x, n in usable if n]
    sums, mask = [1] * (len(usable) + 1), (1 << (room + 1)) - 1
    for k in range(len(usable) - 1, -1, -1):
        x, n = usable[k]
        bits, step = sums[k + 1], 1
        while n:  # so many copies, doubled up
            step = min(step, n)
            bits |= (bits << (x * step)) & mask
            n, step = n - step, 2 * step
        sums[k] = bits

    def reach(k: int, rest: int, filling: Filling) -> Iterator[Filling]:
        if not rest:
            yield filling
            return
        while k < len(usable) and usable[k][0] > rest:
            k += 1
        for j in range(k, len(usable)):
            if not (sums[j] >> rest) & 1:
                return
            x, n = usable[j]
            for m in range(min(n, rest // x), 0, -1):
                if (sums[j + 1] >> (rest - m * x)) & 1:
                    yield from reach(j + 1, rest - m * x, [*filling, (x, m)])

    def whole() -> Iterator[tuple[int, Filling]]:
        for total in range(sums[0].bit_length() - 1, -1, -1):
            if (sums[0] >> total) & 1:
                for found in reach(0, total, []):
                    filling = {first: 1}
                    for x, n in found:
                        filling[x] = filling.get(x, 0) + n
                    yield room - total, sorted(filling.items(), reverse=True)

    first_seen, none = None, True
    for waste, filling in islice(whole(), looks):
        first_seen = first_seen or filling
        if not dominated(filling, counts, waste):
            none = False
            yield filling
    if none:
        yield first_seen


def bin_completion(counts: dict[int, int], capacity: int, dives: int = 4, seen: list[int] | None = None) -> list[tuple[Filling, int]]:
    """The packing with the fewest bins found: [(filling, how often)]. `seen` gets the bins of each whole packing.

    Best fit gives the first incumbent. Each dive then fills the sequence around the
    largest piece left, by the first of its fillings, as often as its lengths last, down
    to a whole packing, or until the bound says that it can't beat the incumbent. The
    first dive takes the first fillings all the way; later ones take the second at one
    place (limited discrepancy search), first where most is left. `dives` bounds them.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    fewest, least = sum(n for _, n in best), least_bins(counts, capacity)
    if seen is not None:
        seen.append(fewest)
    depth = 1
    for dive in range(dives):
        if fewest <= least or dive > depth:
            break
        state, bins, path, left = dict(counts), 0, [], sum(x * n for x, n in counts.items())
        while left and bins + -(-left // capacity) < fewest:
            found = fillings(state, capacity)
            filling = next(found)
            if len(path) + 1 == dive:
                filling = next(found, filling)
            times = min(state[x] // n for x, n in filling)
            for x, n in filling:
                state[x] -= n * times
                left -= x * n * times
            state = {x: n for x, n in state.items() if n}
            bins += times
            path.append((filling, times))
            if len(path) % 16 == 0 and bins + least_bins(state, capacity) >= fewest:
                break
        depth = max(depth, len(path)) if not dive else depth
        if not left:
            if seen is not None:
                seen.append(bins)
            if bins < fewest:
                best, fewest = path, bins
    return best


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each text's ids and the end id; null texts are empty.

    Only texts of more than `capacity` ids are cut: into whole pieces, the first may be shorter.
    """

    def function(batch):
        ids, bounds = BpeEncoder.load(path).encode(batch.column(1))
        rows, piece, start, length, crc, kept = [], [], [], [], [], []
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            own = np.append(ids[a:b], np.uint32(end)).astype("<u4", copy=False)
            cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
            for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                rows.append(k)
                piece.append(p)
                start.append(x)
                length.append(y - x)
                crc.append(zlib.crc32(own[x:y]))
                if keep_ids:
                    kept.append(own[x:y].astype(np.int32))
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), function, schema, limit=1 << 20)


def _plan_rows(plan: list[tuple[Filling, int]], counts: dict[int, int]) -> tuple[list[tuple], list[tuple]]:
    """Rows (length, part, low, high, base, each, skip) that tell the pieces low to high - 1 of a length their places, and (length, width) of the parts.

    The numbers of a length are cut into parts of its mean run, so that a piece meets about
    two rows, however many runs its length has. A plan has at most about `capacity`
    fillings, as each one uses up a length, so there are some ten thousand rows at most.
    """
    runs: dict[int, list[tuple]] = {}
    used, first = dict.fromkeys(counts, 0), 0
    for filling, bins in plan:
        offset = 0
        for length, n in filling:
            runs.setdefault(length, []).append((used[length], used[length] + n * bins, first, n, offset))
            used[length] += n * bins
            offset += n * length
        first += bins
    widths = {length: max(1, counts[length] // len(rows)) for length, rows in runs.items()}
    rows = [(length, part, *run) for length, own in runs.items() for run in own for part in range(run[0] // widths[length], (run[1] - 1) // widths[length] + 1)]
    return rows, list(widths.items())


def pack_pieces(pieces: DataFrame, capacity: int = 1024, dives: int = 4) -> DataFrame:
    """`pieces` (doc_id, piece, length from 1 to capacity, ...) with sequence_id and offset (both long).

    Give it a table that reads the same each time (`materialize`): it is read twice.
    Repeated rows are pieces like any other; a column `_row` that tells rows apart spreads
    them over the tasks that number them.
    """
    spark = pieces.sparkSession
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, widths = _plan_rows(bin_completion(counts, capacity, dives), counts)
    plan = spark.createDataFrame(rows, "length long, _part long, low long, high long, base long, each long, skip long")
    width = spark.createDataFrame(widths, "length long, _width long")
    buckets = max(32, sum(counts.values()) // NUMBERED + 1)
    key = ["_row"] if "_row" in pieces.columns else ["doc_id", "piece"]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before")).join(F.broadcast(width), "length")
    order = Window.partitionBy("length", "_bucket").orderBy(*key)
    numbered = dealt.withColumn("_own", F.row_number().over(order) - 1).join(starts, ["length", "_bucket"])
    numbered = numbered.withColumn("_index", F.col("_own") + F.col("_before")).withColumn("_part", F.floor(F.col("_index") / F.col("_width")).cast("long"))
    placed = numbered.join(F.broadcast(plan), ["length", "_part"]).where("_index >= low and _index < high")
    nth = F.col("_index") - F.col("low")
    return placed.select(
        *(c for c in pieces.columns if c != "_row"),
        (F.col("base") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("skip") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, dives: int = 4) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of `docs` (doc_id, text, ...).

    A null or empty text is one piece of the end id alone. Repeated rows are packed as
    often as they occur, null doc_ids too; extra columns are ignored; an empty table
    gives an empty result.
    """
    pieces = token_pieces(docs, path, capacity, end).withColumn("_row", F.monotonically_increasing_id())  # written with the rows, so it stays
    return pack_pieces(materialize(pieces, "pieces"), capacity, dives)
