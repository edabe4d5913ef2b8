"""The graph index against exact search: recall, what is touched, additions, deletes and filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovesift.operators import graph, vector
from trovesift.sources.scratch import shared_folder
from trovesift.sources.snapshots import Conflict


def some_vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(99).normal(size=(60, 32))
    x = (centers[rng.integers(0, 60, n)] + 0.4 * rng.normal(size=(n, 32))).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<float>")


def recall(index, left, asked, k=10, allowed=None):
    """(share of the true neighbours that are found, share of the vectors that were touched)."""
    exact = left if allowed is None else left.join(allowed, "item_id", "left_semi")
    want = {(r.query_id, r.item_id) for r in vector.knn_batch(exact, asked, k).collect()}
    rows = index.search(asked, k, allowed=allowed).collect()
    assert len(rows) <= len(want) and all(1 <= r["rank"] <= k for r in rows)
    touched = np.mean([t for t in {r.query_id: r.touched for r in rows}.values()]) / left.count()
    return len(want & {(r.query_id, r.item_id) for r in rows}) / len(want), touched


@pytest.fixture(scope="module")
def built(spark):
    x = some_vectors(6000)
    v = table(spark, x).cache()
    return graph.GraphIndex.build(v, shared_folder(spark, "graph")), v, x


def asked_of(v, every=97):
    return v.where(F.col("item_id") % every == 0).select(F.col("item_id").alias("query_id"), "embedding")


def test_recall_and_what_is_touched(built):
    index, v, _ = built
    found, touched = recall(index, v, asked_of(v))
    assert found >= 0.95 and touched < 0.1


def test_several_parts(spark, built):
    _, v, _ = built
    index = graph.GraphIndex.build(v, shared_folder(spark, "parts"), part=2000)
    assert index.parts == 3 and index.graphs.agg(F.sum("nodes")).first()[0] == 6000
    assert recall(index, v, asked_of(v))[0] >= 0.95


def test_queries_in_blocks(built, monkeypatch):
    index, v, _ = built
    whole = {tuple(r) for r in index.search(asked_of(v, 997), 3).collect()}
    monkeypatch.setattr(graph, "TOLD_NUMBERS", 64)
    assert {tuple(r) for r in index.search(asked_of(v, 997), 3).collect()} == whole and len(whole) == 21


def test_filters(spark, built):
    index, v, _ = built
    for share in (3, 50):
        found, touched = recall(index, v, asked_of(v), allowed=v.where(F.col("item_id") % share == 1).select("item_id"))
        assert found >= 0.95 and touched < 0.15
    assert index.search(asked_of(v), 5, allowed=v.limit(0).select("item_id")).count() == 0


def test_additions_and_deletes(spark, built):
    index, v, x = built
    more = table(spark, some_vectors(500, 1), 5900)  # a hundred are new vectors of old ids
    grown = index.add(more)
    gone = v.where("item_id % 10 = 3").select("item_id")
    left = grown.delete(gone)
    now = v.join(more, "item_id", "left_anti").unionByName(more).join(gone, "item_id", "left_anti").cache()
    assert left.graphs.agg(F.sum("living")).first()[0] == now.count()
    found, touched = recall(left, now, asked_of(now))
    assert found >= 0.95 and touched < 0.12
    worn = left.delete(v.where("item_id % 10 in (1, 2)").select("item_id"))  # beyond the share: built anew
    assert worn.graphs.where("nodes <> living").count() == 0
    assert recall(worn, now.where("item_id % 10 not in (1, 2)"), asked_of(now))[0] >= 0.95
    assert graph.GraphIndex(spark, index.path, index.state.version).graphs.agg(F.sum("nodes")).first()[0] == 6000  # the old version is still there
    with pytest.raises(Conflict):
        grown.delete(gone)  # made from a version that has changed since


def test_empty_and_odd_vectors(spark):
    empty = graph.GraphIndex.build(table(spark, some_vectors(0)), shared_folder(spark, "none"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    assert empty.search(asked, 3).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0, 0.0])], "item_id long, embedding array<float>")
    index = graph.GraphIndex.build(rows, shared_folder(spark, "odd"))
    assert [(r.query_id, r.item_id) for r in index.search(asked, 3).orderBy("rank").collect()] == [(1, 1), (1, 4), (1, 2)]
    with pytest.raises(ValueError):
        graph.GraphIndex.build(rows.unionByName(spark.createDataFrame([(9, [1.0])], rows.schema)), shared_folder(spark, "lengths"))


def test_adding_copies_the_vectors_once(monkeypatch):
    """A change grows a part's arrays once, not for each vector; an empty part takes vectors too."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part, copies = graph.Part(np.arange(100), x[:100]), []
    whole = np.concatenate
    monkeypatch.setattr(graph.np, "concatenate", lambda arrays, *a, **k: copies.append(1) or whole(arrays, *a, **k))
    part.add(np.arange(100, 300), x[100:])
    assert len(copies) < 10 and part.ids.tolist() == list(range(300)) and part.x.shape == (300, 8)
    empty = graph.Part(np.zeros(0), np.zeros((0, 1)))
    empty.add(np.arange(5), x[:5])
    assert empty.search(x[3], 1)[0][0][0] == 3 and part.search(x[250], 1)[0][0][0] == 250
