import hashlib
import math

import numpy as np
import pytest

from spanlight.llm import queries
from spanlight.llm.clustering import ClusterOptions, Tree, cluster_vectors


def plain(rows, k=40, rounds=5, width=64, scale=256, seed="2"):
    """Python integers all the way: rows (id, vector) to sorted (id, cluster, distance, inertias, centroid)."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    marks = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    centroids = [q for _, q in marks[:k]]
    assign = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, q in kept:
            own[assign(q)[1]].append(q)
        centroids = [[sum(x) // len(qs) for x in zip(*qs)] if qs else c for c, qs in zip(centroids, own)]
    ends = [(i, *assign(q)) for i, q in kept]
    by = {}
    for _, d, c in ends:
        by[c] = by.get(c, 0) + d
    return sorted(((i, c, d, by[c], sum(by.values()), centroids[c]) for i, d, c in ends), key=str)


def rows_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    found = queries.op12_centroid_clustering(spark, path).collect()
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    assert sorted((tuple(r) for r in found), key=str) == sorted(((*x[:5], digest(x[5])) for x in plain(rows)), key=str)


@pytest.mark.parametrize("block,leaf", [(4096, 32), (7, 1), (64, 5)])
def test_trees_of_any_shape_agree(spark, block, leaf):
    """Integers with many ties and repeated vectors, negative means, and clusters that stay empty."""
    rng = np.random.default_rng(4)
    v = np.r_[rng.integers(-3, 3, (300, 3)), np.zeros((20, 3), int), rng.integers(-3, 3, (30, 3)) + 1000] / 2
    rows = [(int(i % 200), x.tolist()) for i, x in enumerate(v)]
    options = ClusterOptions(clusters=12, rounds=4, components=3, scale=2.0, seed="s", block=block, leaf=leaf)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert rows_of(cluster_vectors(df, options)) == plain(rows, 12, 4, 3, 2, "s")


def test_nodes_are_pruned_and_assigned_whole():
    rng = np.random.default_rng(1)
    centers = rng.integers(-1000, 1000, (20, 16))
    points = np.concatenate([c + rng.integers(-20, 20, (200, 16)) for c in centers])
    tree = Tree(points, 16)
    alone = sum(tree._undominated(5, np.array([i]), np.ones((1, 20), bool), centers).sum() == 1 for i in range(32))
    assert alone > 8
    again = Tree.opened(tree.pack())
    assert np.array_equal(again.points, points[tree.order]) and all(map(np.array_equal, again.sums, tree.sums))


def test_large_values_are_exact_or_refused(spark):
    options = ClusterOptions(clusters=3, rounds=2, components=4)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-(2**25), 2**25, 4) / 256 + 1 / 1024).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(cluster_vectors(df, options)) == plain(rows, 3, 2, 4)
    huge = spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit 64 bits"):
        cluster_vectors(huge, options).collect()


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, cluster string, distance int, v int, id int"
    assert cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    rng = np.random.default_rng(0)
    good = [rng.normal(size=64).astype(np.float32).tolist() for _ in range(5)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] * 64, [float("nan")] * 64, [1.0] * 63 + [float("-inf")]]
    rows = [(i, v) for i, v in enumerate(bad)] + [(7, good[0]), (7, good[0]), (7, good[1]), (None, good[2]), (9, good[3]), (10, good[4])]
    df = spark.createDataFrame([(i, v, "c", 1, 2, 3) for i, v in rows], schema)
    assert rows_of(cluster_vectors(df)) == plain(rows)
    assert cluster_vectors(df.filter("vec_id < 7")).collect() == []
