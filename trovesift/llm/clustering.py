"""Centroid clustering by exponion search, with exact integer arithmetic.

Newling & Fleuret, "Fast k-means with accurate bounds" (2016): each vector keeps an upper
bound of the distance to its own centroid and a lower bound of the distance to every
other. Where they don't settle it, its nearest centroid is inside a ball around its own
one, with radius twice the upper bound plus that centroid's distance to the next; sorted
lists of the distances between centroids, cut in annuli that double, give the candidates.

Vectors are integers, so distances and sums are exact; the bounds are widened by a hair,
and the radius is inclusive, so that ties reach the exact comparison, where the smaller
number wins. A round is a job: tasks assign their vectors, and the sums change by those
that moved, added up in tasks. Only k centroids and k rows of sums come to the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovesift.llm.shared import discard, materialize

#: Components beyond this can't be measured in 64 bits.
LARGEST = 1 << 26
#: Rows that are turned into arrays at once.
ROWS = 4096
#: Widening of bounds, far above what rounding of square roots can do.
HAIR = 1e-9


def kept_vectors(df: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """`df` (vec_id, embedding) with `point`: floor(scale * component) of vectors with `dimensions` components, all finite and at most LARGEST when scaled; other rows are left out."""
    value = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(F.lit(float(scale)) * x.cast("double")) <= float(LARGEST))
    rows = df.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions)).where(F.forall("embedding", good))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: value(x).cast("int")).alias("point"))


@dataclass
class Centroids:
    """Places of k centroids (int64), and what the search needs of their mutual distances."""

    places: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.places)
        between = np.sqrt(distances(self.places, self.places).astype(np.float64)) if k else np.zeros((0, 0))
        np.fill_diagonal(between, -1.0)
        self.order = np.argsort(between, axis=1, kind="stable")  # itself first, then by distance
        np.fill_diagonal(between, 0.0)
        self.sorted = np.take_along_axis(between, self.order, 1)
        self.next = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c."""
    top = max((int(np.abs(a).max()) for a in (x, c) if a.size), default=0)
    if 4 * top * top * x.shape[1] < 1 << 53:  # all sums are whole numbers that doubles hold
        x, c = x.astype(np.float64), c.astype(np.float64)
        return np.rint((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def assign(points: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray, told: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) of points with cluster `was` and bounds that hold for `told`; without a cluster (-1) all centroids are looked at."""
    cluster, upper, lower = was.copy(), upper.copy(), lower.copy()
    k = len(told.places)

    def look(rows, candidates, beyond) -> None:
        """The exact nearest among candidates; `beyond` bounds the distance to all others."""
        found = distances(points[rows], told.places[candidates])
        by_number = np.argsort(candidates, kind="stable")
        pick = by_number[found[:, by_number].argmin(1)]
        best = found[np.arange(len(rows)), pick]
        cluster[rows] = np.asarray(candidates)[pick]
        upper[rows] = np.sqrt(best.astype(np.float64)) * (1 + HAIR)
        found[np.arange(len(rows)), pick] = np.iinfo(np.int64).max
        second = np.sqrt(found.min(1).astype(np.float64)) if len(candidates) > 1 else np.full(len(rows), np.inf)
        lower[rows] = np.minimum(second, beyond) * (1 - HAIR)

    new = np.flatnonzero(was < 0)
    if len(new):
        look(new, np.arange(k), np.inf)
    safe = lambda rows: np.maximum(told.next[cluster[rows]] / 2, lower[rows]) > upper[rows]
    rows = np.flatnonzero(was >= 0)
    rows = rows[~safe(rows)]
    if len(rows):  # a tight upper bound, and another look
        own = ((points[rows].astype(np.int64) - told.places[cluster[rows]]) ** 2).sum(1)
        upper[rows] = np.sqrt(own.astype(np.float64)) * (1 + HAIR)
        rows = rows[~safe(rows)]
    for a in np.unique(cluster[rows]).tolist():
        own = rows[cluster[rows] == a]
        radius = (2 * upper[own] + told.next[a]) * (1 + HAIR)
        reach = np.searchsorted(told.sorted[a], radius, side="right")  # inclusive
        annulus = np.minimum(1 << np.ceil(np.log2(np.maximum(reach, 2))).astype(int), k)
        for m in np.unique(annulus).tolist():
            some = own[annulus == m]
            # Who isn't looked at is at least the next listed distance, less the upper bound, away.
            beyond = told.sorted[a][m] - upper[some] if m < k else np.inf
            look(some, told.order[a][:m], beyond)
    return cluster, upper, lower


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


STATE = "vec_id long, point array<int>, cluster int, was int, upper double, lower double"


def _assigned(state: DataFrame, told: Centroids, moved: np.ndarray) -> DataFrame:
    """The next state, given how far each centroid moved since the bounds were made."""
    shared = state.sparkSession.sparkContext.broadcast((told, moved))

    def run(batches):
        told, moved = shared.value
        most = np.sort(moved)[::-1]
        others = np.where((moved == most[0]) & (np.count_nonzero(moved == most[0]) == 1), most[1] if len(most) > 1 else 0.0, most[0])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                was, upper, lower = (part.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 4, 5))
                old = was >= 0
                upper[old] = (upper[old] + moved[was[old]]) * (1 + HAIR)
                lower[old] = (lower[old] - others[was[old]]) * (1 - HAIR) - HAIR
                cluster, upper, lower = assign(_points(part.column(1)), was, upper, lower, told)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower)], [x.split()[0] for x in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def _changes(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """What moved vectors add to the sums and counts of all clusters: exact, added up in tasks first."""
    moved = state.where("cluster <> was")
    signs = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))).alias("s")
    signed = moved.select("point", signs).where("s.c >= 0")
    total = [F.sum(F.col("point")[i].cast("long") * F.col("s.sign")).alias(f"x{i}") for i in range(dimensions)]
    sums, counts = np.zeros((k, dimensions), object), np.zeros(k, object)
    for row in signed.groupBy(F.col("s.c").alias("c")).agg(F.sum("s.sign").alias("n"), *total).collect():
        sums[row.c] = [row[f"x{i}"] for i in range(dimensions)]
        counts[row.c] = row.n
    return sums, counts


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector (vec_id, embedding) of `kept_vectors`.

    The first centroids are the k vectors with the smallest sha256 of ``seed:vec_id``, in
    that order (equal ids by their components; a null id is the word null); fewer vectors
    than k are all centroids. Ties go to the smaller number, so of equal centroids the
    later ones stay empty and where they are. Repeated rows count as often as they occur;
    null, short or non-finite vectors are left out, as are components beyond LARGEST; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    points = kept_vectors(vectors, dimensions, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = points.orderBy(order, "point").limit(k).select("point").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    told = Centroids(np.array([r.point for r in first], np.int64))
    k = len(first)
    state = points.select("vec_id", "point", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    moved, sums, counts, before = np.zeros(k), np.zeros((k, dimensions), object), np.zeros(k, object), None
    for _ in range(rounds):
        state = materialize(_assigned(state, told, moved), "clustered")
        if before is not None:
            discard(before)
        before = state
        more, n = _changes(state, k, dimensions)
        sums, counts = sums + more, counts + n
        places = told.places.copy()
        for c in range(k):
            if counts[c]:
                places[c] = [s // counts[c] for s in sums[c]]
        moved = np.sqrt(((places - told.places) ** 2).sum(1).astype(np.float64))
        told = Centroids(places)
    state = materialize(_assigned(state, told, moved), "clustered")
    if before is not None:
        discard(before)
    return _measured(state, told)


def _measured(state: DataFrame, told: Centroids) -> DataFrame:
    spark = state.sparkSession
    names = [hashlib.sha256(",".join(map(str, place)).encode()).hexdigest() for place in told.places.tolist()]
    centers = spark.createDataFrame([(c, place, name) for c, (place, name) in enumerate(zip(told.places.tolist(), names, strict=True))], "cluster int, center array<long>, centroid_sha256 string")
    square = lambda x, y: (x.cast("long") - y) * (x.cast("long") - y)
    distance = F.aggregate(F.zip_with("point", "center", square), F.lit(0).cast("long"), lambda a, b: a + b)
    rows = state.select("vec_id", "point", "cluster").join(F.broadcast(centers), "cluster").select("vec_id", "cluster", distance.alias("distance"), "centroid_sha256")
    inertia = {r.cluster: r.d for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    sums = spark.createDataFrame([(c, d, sum(inertia.values())) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: str = "1") -> str:
    """The same in DuckDB's SQL: every round is a join of all vectors with all centroids."""
    assigned = lambda n: f"""a{n} AS (SELECT vec_id, p, unnest(min_by(struct_pack(c := c, d := d), (d, c))) FROM (
  SELECT vec_id, row, v.p, c, CAST(list_inner_product(v.p, v.p) - 2 * list_inner_product(v.p, q.p) + list_inner_product(q.p, q.p) AS BIGINT) AS d
  FROM kept v, c{n} q) GROUP BY vec_id, row, p)"""  # noqa: E731
    moved = lambda n: f"""s{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(p) AS x, unnest(range({dimensions})) AS i FROM a{n - 1}) GROUP BY c, i),
c{n} AS (SELECT o.c, coalesce(m.p, o.p) AS p FROM c{n - 1} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS p FROM s{n} GROUP BY c) m ON m.c = o.c)"""  # noqa: E731
    steps = [assigned(0)]
    for n in range(1, rounds + 1):
        steps += [moved(n), assigned(n)]
    return f"""
WITH kept AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS p FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, p FROM kept ORDER BY c LIMIT {k}),
{", ".join(steps)},
named AS (SELECT c, sha256(array_to_string(list_transform(p, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS name FROM c{rounds})
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, name AS centroid_sha256
FROM a{rounds} a JOIN named USING (c)"""
