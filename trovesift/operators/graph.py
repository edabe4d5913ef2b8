"""Nearest neighbours by layered graphs of near vectors, that grow and forget.

Malkov & Yashunin (2020): vectors of a part are nodes; each links to near ones that are
not nearer to one another, and ever fewer of them are in the layers above. A search
walks down the layers and keeps a list of the best at the lowest, touching few vectors.
Parts are dealt by a hash of the item, so a search runs in all parts at once and their
lists are merged; a part is built in a task from exact neighbours of its blocks. New
vectors are linked into their parts and deleted ones marked, in commits of one log;
parts with too many marked are built anew.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovesift.operators.embedding import DELETED_SHARE
from trovesift.operators.vector import TOLD_NUMBERS
from trovesift.sources.snapshots import Snapshots

#: Vectors of a part, links of a node in the lowest layer, and the share of nodes in each next layer.
PART, LINKS, FEWER = 32_768, 32, 16
#: Length of the list that a search keeps, and of that which finds a new vector's links.
WIDTH, WIDTH_ADDED = 64, 100
#: Length of the list in the layers above.
WIDTH_ABOVE = 40
#: Below this share of allowed vectors they are compared one by one.
FEW_ALLOWED = 0.05


def _apart(x: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> list[int]:
    """Of `near` in falling similarity, those that are nearer to the node than to any one chosen before; filled up with the next ones."""
    chosen: list[int] = []
    between = x[near] @ x[near].T
    closest = np.full(len(near), -np.inf, between.dtype)  # of each, to what is chosen
    for k in range(len(near)):
        if len(chosen) >= most:
            break
        if closest[k] < sims[k]:
            chosen.append(k)
            np.maximum(closest, between[:, k], out=closest)
    taken = set(chosen)
    rest = [k for k in range(len(near)) if k not in taken]
    return near[(chosen + rest[: max(0, most // 2 - len(chosen))])].tolist()


class Part:
    """One graph: ids, unit vectors, layers of links (a list of nodes by node), and which nodes are marked as deleted."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 3) -> None:
        self.ids, self.x, self.seed = ids.astype(np.int64), x.astype(np.float32), seed
        self.dead = np.zeros(len(ids), bool)
        self.height = self._heights(self.ids)
        self.layers: list[dict[int, list[int]]] = []
        for layer in range(int(self.height.max(initial=0)) + 1):
            self.layers.append(self._linked(np.flatnonzero(self.height >= layer), LINKS if layer == 0 else LINKS // 2))
        self.entry = int(self.height.argmax()) if len(ids) else -1

    def _heights(self, ids: np.ndarray) -> np.ndarray:
        """A node's top layer follows from its id."""
        mixed = (ids.astype(np.uint64) + np.uint64(self.seed)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        share = ((mixed >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
        return np.minimum(np.floor(-np.log(share) / np.log(FEWER)), 6).astype(np.int64)

    def _linked(self, nodes: np.ndarray, most: int) -> dict[int, list[int]]:
        """Links of each node to its exact near ones, both ways."""
        x, near = self.x[nodes], min(len(nodes) - 1, 2 * most)
        links: dict[int, list[int]] = {}
        for at in range(0, len(nodes), 1024):
            sims = x[at : at + 1024] @ x.T
            rows = np.arange(len(sims))
            sims[rows, at + rows] = -np.inf
            if near <= 0:
                links.update((int(n), []) for n in nodes[at : at + 1024])
                continue
            found = np.argpartition(-sims, near - 1, axis=1)[:, :near]
            values = np.take_along_axis(sims, found, 1)
            order = np.argsort(-values, axis=1, kind="stable")
            found, values = np.take_along_axis(found, order, 1), np.take_along_axis(values, order, 1)
            for k in range(len(found)):
                links[int(nodes[at + k])] = _apart(self.x, nodes[found[k]], values[k], most // 2)
        for a, own in list(links.items()):
            for b in own[: most // 2]:
                if a not in links[b]:
                    links[b].append(a)
        for a, own in links.items():
            if len(own) > most:
                links[a] = self._fewer(a, own, most)
        self._joined(nodes, links)
        return links

    def _joined(self, nodes: np.ndarray, links: dict[int, list[int]]) -> None:
        """Link every group of nodes that can't be reached from the others to its nearest node outside, both ways."""
        place = {int(n): k for k, n in enumerate(nodes)}
        top = np.arange(len(nodes))

        def root(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        for a, own in links.items():
            for b in own:
                u, v = root(place[a]), root(place[b])
                top[max(u, v)] = min(u, v)
        top = np.array([root(k) for k in range(len(nodes))])
        while len(roots := np.unique(top)) > 1:
            inside = top == min(roots, key=lambda r: (int((top == r).sum()), int(r)))
            ours, theirs = nodes[inside], nodes[~inside]
            sims = np.stack([(self.x[theirs] @ self.x[n]) for n in ours])
            a, b = np.unravel_index(int(sims.argmax()), sims.shape)
            links[int(ours[a])].append(int(theirs[b]))
            links[int(theirs[b])].append(int(ours[a]))
            top[inside] = top[np.flatnonzero(nodes == theirs[b])[0]]

    def _fewer(self, node: int, own: list[int], most: int) -> list[int]:
        near = np.array(own)
        sims = self.x[near] @ self.x[node]
        order = np.argsort(-sims, kind="stable")
        return _apart(self.x, near[order], sims[order], most)

    def _walk(self, q: np.ndarray, starts: list[int], layer: int, width: int, touched: set[int]) -> list[tuple[float, int]]:
        """The best `width` nodes of a layer that a search from `starts` finds, best first."""
        seen = set(starts)
        touched.update(starts)
        sims = self.x[starts] @ q
        best = [(float(s), n) for s, n in zip(sims, starts, strict=True)]
        heapq.heapify(best)
        open_ = [(-s, n) for s, n in best]
        heapq.heapify(open_)
        links = self.layers[layer]
        while open_:
            s, node = heapq.heappop(open_)
            if len(best) >= width and -s < best[0][0]:
                break
            new = [n for n in links.get(node, ()) if n not in seen]
            if not new:
                continue
            seen.update(new)
            touched.update(new)
            for value, n in zip((self.x[new] @ q).tolist(), new, strict=True):
                if len(best) < width or value > best[0][0]:
                    heapq.heappush(best, (value, n))
                    heapq.heappush(open_, (-value, n))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted(best, key=lambda t: (-t[0], t[1]))

    def _down(self, q: np.ndarray, to: int, touched: set[int]) -> list[int]:
        """Where to begin at a layer: several of the best above it, as clusters may be linked there alone."""
        starts = [self.entry]
        for layer in range(len(self.layers) - 1, to, -1):
            starts = [n for _, n in self._walk(q, starts, layer, WIDTH_ABOVE, touched)]
        return starts

    def search(self, q: np.ndarray, k: int, width: int = WIDTH, allowed: np.ndarray | None = None) -> tuple[list[tuple[int, float]], int]:
        """The `k` best (item, similarity) that a search finds among living (and allowed) vectors, and how many vectors it touched."""
        good = ~self.dead if allowed is None else ~self.dead & allowed
        count = int(good.sum())
        if not count:
            return [], 0
        q = q.astype(np.float32)
        if count <= max(k, FEW_ALLOWED * len(self.ids)):
            rows = np.flatnonzero(good)
            found = sorted(zip((-(self.x[rows] @ q)).tolist(), self.ids[rows].tolist(), strict=True))[:k]
            return [(i, -s) for s, i in found], count
        touched: set[int] = set()
        width = int(max(width, k) * min(4.0, max(1.0, (len(self.ids) / count) ** 0.5)))  # fewer good ones, a longer list
        found = self._walk(q, self._down(q, 0, touched), 0, width, touched)
        kept = [(int(self.ids[n]), s) for s, n in found if good[n]]
        return sorted(kept, key=lambda t: (-t[1], t[0]))[:k], len(touched)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Link new vectors in, one by one; an id that is there already is marked first."""
        self.mark(ids)
        there, heights = len(self.ids), self._heights(ids.astype(np.int64))
        self.ids, self.x = np.concatenate([self.ids, ids.astype(np.int64)]), np.concatenate([self.x.reshape(there, x.shape[1]), x.astype(np.float32)])
        self.dead, self.height = np.concatenate([self.dead, np.zeros(len(ids), bool)]), np.concatenate([self.height, heights])
        for node in range(there, len(self.ids)):
            v, height = self.x[node], int(self.height[node])
            if self.entry < 0:
                self.layers, self.entry = [{node: []} for _ in range(height + 1)], node
                continue
            touched: set[int] = set()
            starts = self._down(v, height, touched)
            for layer in range(min(height, len(self.layers) - 1), -1, -1):
                most = LINKS if layer == 0 else LINKS // 2
                found = self._walk(v, starts, layer, WIDTH_ADDED, touched)
                starts = [n for _, n in found]
                own = _apart(self.x, np.array(starts), np.array([s for s, _ in found]), most // 2)
                self.layers[layer][node] = own
                for other in own:
                    theirs = self.layers[layer][other]
                    theirs.append(node)
                    if len(theirs) > most:
                        self.layers[layer][other] = self._fewer(other, theirs, most)
            while len(self.layers) <= height:
                self.layers.append({node: []})
                self.entry = node

    def mark(self, ids: np.ndarray) -> None:
        """Mark vectors as deleted: they are still walked through, and never found."""
        self.dead |= np.isin(self.ids, ids)

    def worn(self) -> bool:
        return bool(self.dead.sum() > DELETED_SHARE * len(self.ids))

    def renewed(self) -> Part:
        return Part(self.ids[~self.dead], self.x[~self.dead], self.seed)


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class GraphIndex:
    """Graphs of all parts in a log of commits; `vector.knn_batch` is the exact way beside it."""

    TABLES = {"parts": "part int, nodes long, living long, graph binary", "shape": "parts int, dimensions int"}

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Snapshots(spark, self.path, self.TABLES)
        self.state = self.log.state(version)
        self.graphs = self.log.read("parts", state=self.state)
        shape = self.log.read("shape", state=self.state).first()
        self.parts, self.dimensions = (shape.parts, shape.dimensions) if shape else (0, 0)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("item_id"), F.lit(self.parts)).cast("int")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, part: int = PART) -> GraphIndex:
        """A new index of all vectors (item_id, embedding) with an id and a vector; of an id that repeats, one is kept. About `part` of them share a graph."""
        spark = vectors.sparkSession
        rows = vectors.where("item_id is not null and embedding is not null").groupBy("item_id").agg(F.min("embedding").alias("embedding"))
        sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.min(F.size("embedding")).alias("least")).first()
        if sizes.n and sizes.d != sizes.least:
            raise ValueError("vectors of different lengths")
        made = cls(spark, path)
        made.parts, made.dimensions = max(1, -(-sizes.n // part)), sizes.d or 0
        shape = spark.createDataFrame([(made.parts, made.dimensions)], cls.TABLES["shape"])
        made.log.commit({"parts": made._changed(rows, None), "shape": shape}, overwrite=tuple(cls.TABLES))
        return cls(spark, path)

    def _changed(self, rows: DataFrame, old: DataFrame | None) -> DataFrame:
        """Graphs of the parts that `rows` (item_id, embedding or null for a delete) belong to, with these in."""

        def one(ids: pa.Array, vectors: pa.Array, graph: bytes | None, number: int) -> pa.RecordBatch:
            item, there = ids.to_numpy(zero_copy_only=False), np.array(vectors.is_valid())
            if graph is None:
                part = Part(item[there], _unit(vectors.filter(pa.array(there)))) if there.any() else Part(np.zeros(0), np.zeros((0, 1)))
            else:
                part = pickle.loads(graph)
                part.mark(item[~there])
                if there.any():
                    part.add(item[there], _unit(vectors.filter(pa.array(there))))
                if part.worn():
                    part = part.renewed()
            living = len(part.ids) - int(part.dead.sum())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(part.ids)], pa.int64()), pa.array([living], pa.int64()), pa.array([pickle.dumps(part)], pa.binary())], ["part", "nodes", "living", "graph"])

        dealt = rows.select(self._part().alias("part"), "item_id", F.col("embedding").cast("array<float>").alias("embedding"))
        if old is None:

            def fresh(key: tuple, batches: pa.Table) -> pa.Table:
                table = batches.sort_by("item_id")
                return pa.Table.from_batches([one(table.column("item_id").combine_chunks(), table.column("embedding").combine_chunks(), None, key[0].as_py())])

            return dealt.groupBy("part").applyInArrow(fresh, self.TABLES["parts"])

        def joined(key: tuple, news: pa.Table, graphs: pa.Table) -> pa.Table:
            table = news.sort_by("item_id")
            graph = graphs.column("graph")[0].as_py() if graphs.num_rows else None
            return pa.Table.from_batches([one(table.column("item_id").combine_chunks(), table.column("embedding").combine_chunks(), graph, key[0].as_py())])

        touched = old.join(dealt.select("part").distinct(), "part", "left_semi")
        return dealt.groupBy("part").cogroup(touched.groupBy("part")).applyInArrow(joined, self.TABLES["parts"])

    def _commit(self, rows: DataFrame) -> GraphIndex:
        parts = rows.select(self._part().alias("part")).distinct()
        self.log.commit({"parts": self._changed(rows, self.graphs)}, {"parts": ("part", parts)}, read=self.state.version)
        return GraphIndex(self.spark, self.path)

    def add(self, vectors: DataFrame) -> GraphIndex:
        """The index with these vectors (item_id, embedding), in place of older ones of the same ids."""
        return self._commit(vectors.where("item_id is not null and embedding is not null").groupBy("item_id").agg(F.min("embedding").alias("embedding")))

    def delete(self, gone: DataFrame) -> GraphIndex:
        """The index without the items of `gone` (item_id); parts that wore out are built anew."""
        return self._commit(gone.select("item_id").where("item_id is not null").distinct().withColumn("embedding", F.lit(None).cast("array<float>")))

    def search(self, queries: DataFrame, k: int = 10, width: int = WIDTH, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, item_id, similarity, touched): about the `k` nearest of each query (query_id, embedding), among the items of `allowed` if it is given, and how many vectors were compared for the query.

        Queries are told to all tasks in blocks of bounded size; every part's task gives `k` for each.
        """
        known = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
        blocks = -(-(known.agg(F.sum(F.size("embedding"))).first()[0] or 0) // TOLD_NUMBERS)
        if blocks > 1:
            return reduce(DataFrame.unionByName, (self._search(known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k, width, allowed) for b in range(blocks)))
        return self._search(known, k, width, allowed)

    def _search(self, known: DataFrame, k: int, width: int, allowed: DataFrame | None) -> DataFrame:
        asked = known.toArrow()
        schema = known.select("query_id").schema.add("item_id", "long").add("similarity", "double").add("touched", "long")
        if not asked.num_rows or not self.parts:
            return self.spark.createDataFrame([], schema).withColumn("rank", F.lit(1)).select("query_id", "rank", "item_id", "similarity", "touched")
        column = asked.column("embedding").combine_chunks()
        told = self.spark.sparkContext.broadcast((asked.column("query_id").combine_chunks(), _unit(column)))
        graphs = self.graphs.select("part", "graph", F.lit(None).cast("array<long>").alias("allowed"))
        if allowed is not None:
            lists = allowed.select("item_id").distinct().groupBy(self._part().alias("part")).agg(F.collect_list("item_id").alias("allowed"))
            graphs = self.graphs.select("part", "graph").join(lists, "part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = told.value
            for batch in batches:
                for graph, some in zip(batch.column(1), batch.column(2), strict=True):
                    part = pickle.loads(graph.as_py())
                    good = np.isin(part.ids, np.array(some.as_py())) if some.is_valid else None
                    rows = [(q, item, s, n) for q, v in enumerate(vectors) for found, n in [part.search(v, k, width, good)] for item, s in found]
                    if rows:
                        q, item, s, n = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(item, pa.int64()), pa.array(s, pa.float64()), pa.array(n, pa.int64())], ["query_id", "item_id", "similarity", "touched"])

        found = graphs.repartition(self.parts, "part").mapInArrow(run, schema).withColumn("part", self._part())
        touched = found.groupBy("query_id", "part").agg(F.max("touched").alias("t")).groupBy("query_id").agg(F.sum("t").alias("touched"))
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
        best = found.drop("touched").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.join(touched, "query_id").select("query_id", "rank", "item_id", "similarity", "touched")
