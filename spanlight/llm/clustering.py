"""Centroid clustering by kd-tree filtering, in whole numbers.

Every task builds kd-trees over blocks of its vectors. A node holds the number, the sum and the
bounding box of its vectors, and its vectors lie side by side. The trees are built once and
kept as a table; a round sends the centroids to them. Going down a tree level by level, every
node keeps the centroids that may be nearest to some vector in its box: of those of its parent,
one goes if at every place of the box another is strictly nearer, which the one corner that
favours it most shows. A node with one centroid left is assigned as a whole by its number and
sum; leaves are resolved exactly among theirs. Pruning is strict, so ties are decided among all
that tie, and the smallest number wins.

All arithmetic is on integers and exact, so the result depends neither on how the vectors are
dealt to tasks nor on their order. Sums are added up in a task before the shuffle: a round brings
clusters x components sums to the driver, whatever the number of vectors.

A component x becomes floor(scale * x), x as double. Vectors that are null, have another number
of components, or a component that is null, NaN or infinite are left out. Components whose
integer reaches 2^26 would make distances that 64 bits cannot hold; they are an error that says
so. Rows that repeat an id are vectors of their own; where starting rows tie by the hash of their id,
their components decide. A null id is hashed as the empty text. Fewer vectors than clusters
give as many centroids as there are vectors. Columns beside id and vector are not looked at.
An empty table, or one without a valid vector, gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, column

#: Integers are smaller than this, so that sums of squared differences of 64 components fit 64 bits.
TOO_LARGE = 1 << 26


@dataclass(frozen=True)
class ClusterOptions:
    clusters: int = 40
    rounds: int = 5
    components: int = 64
    scale: float = 256.0
    seed: str = "2"
    block: int = 4096
    leaf: int = 32


class Tree:
    """A kd-tree over the rows of an integer matrix.

    Its levels are full: level l has 2^l nodes, and node i of a level covers the rows from
    edges[l][i] to edges[l][i + 1] after `order`. Rows of a node are split in halves by their
    order along the widest side of its box.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        edges = [np.array([0, len(points)])]
        while np.diff(edges[-1]).max(initial=0) > leaf:
            below = [0]
            for lo, hi in zip(edges[-1][:-1], edges[-1][1:]):
                own = self.order[lo:hi]
                part, middle = points[own], (hi - lo) // 2
                if hi - lo > 1:
                    side = int(np.argmax(part.max(0) - part.min(0)))
                    self.order[lo:hi] = own[np.argpartition(part[:, side], middle, kind="introselect")]
                below += [lo + middle, hi]
            edges.append(np.array(below))
        self._measure(points[self.order], edges)

    def _measure(self, points: np.ndarray, edges: list[np.ndarray]) -> None:
        self.points, self.edges = points, edges
        self.low, self.high, self.sums = [], [], []
        for e in edges:
            full = e[:-1] < e[1:]
            at = e[:-1][full]
            shape = (len(e) - 1, points.shape[1])
            low, high, sums = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
            if len(at):
                low[full], high[full] = np.minimum.reduceat(points, at), np.maximum.reduceat(points, at)
                sums[full] = np.add.reduceat(points, at, dtype=np.int64)
            self.low.append(low)
            self.high.append(high)
            self.sums.append(sums)

    def pack(self) -> bytes:
        """The points in their order, as the smallest integers that hold them, and the edges; boxes and sums follow from both."""
        most = int(np.abs(self.points).max(initial=0))
        kind = np.int16 if most < 1 << 15 else np.int32
        head = np.array([len(self.edges), self.points.shape[1], np.dtype(kind).itemsize], np.int64)
        return head.tobytes() + b"".join(e.astype(np.int64).tobytes() for e in self.edges) + np.ascontiguousarray(self.points.astype(kind)).tobytes()

    @classmethod
    def opened(cls, raw: bytes) -> Tree:
        levels, width, size = np.frombuffer(raw, np.int64, 3)
        edges, at = [], 24
        for level in range(levels):
            edges.append(np.frombuffer(raw, np.int64, (1 << level) + 1, at))
            at += 8 * ((1 << level) + 1)
        points = np.frombuffer(raw, np.int16 if size == 2 else np.int32, -1, at).astype(np.int64).reshape(-1, width)
        tree = cls.__new__(cls)
        tree._measure(points, edges)
        return tree

    def assign(self, centroids: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(numbers, sums) by cluster; with each also (cluster, squared distance) by row."""
        k = len(centroids)
        numbers, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
        cluster = np.full(len(self.points), -1)
        nodes, may = np.array([0]), np.ones((1, k), bool)
        for level, edges in enumerate(self.edges):
            full = edges[nodes] < edges[nodes + 1]
            nodes, may = nodes[full], may[full]
            may = self._undominated(level, nodes, may, centroids)
            alone = may.sum(1) == 1
            of = may[alone].argmax(1)
            lo, hi = edges[nodes[alone]], edges[nodes[alone] + 1]
            np.add.at(numbers, of, hi - lo)
            np.add.at(sums, of, self.sums[level][nodes[alone]])
            for a, b, c in zip(lo, hi, of):
                cluster[a:b] = c
            nodes, may = nodes[~alone], may[~alone]
            if level + 1 < len(self.edges):
                nodes, may = np.r_[2 * nodes, 2 * nodes + 1], np.r_[may, may]
        if len(nodes):
            sizes = edges[nodes + 1] - edges[nodes]
            rows = np.concatenate([np.arange(a, b) for a, b in zip(edges[nodes], edges[nodes + 1])])
            gap = distances(self.points[rows], centroids)
            gap[~np.repeat(may, sizes, axis=0)] = np.iinfo(np.int64).max
            of = gap.argmin(1)
            cluster[rows] = of
            np.add.at(numbers, of, 1)
            np.add.at(sums, of, self.points[rows])
        if not each:
            return numbers, sums, None, None
        off = self.points - centroids[cluster]
        return numbers, sums, cluster, (off * off).sum(1)

    def _undominated(self, level: int, nodes: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """The centroids that the best of each node, the one nearest to the middle of its box, does not dominate strictly."""
        low, high = self.low[level][nodes], self.high[level][nodes]
        from_middle = distances(low + high, 2 * centroids)
        from_middle[~may] = np.iinfo(np.int64).max
        best = centroids[from_middle.argmin(1)]
        out = np.empty_like(may)
        for j, c in enumerate(centroids):
            toward = c - best
            corner = np.where(toward > 0, high, low)
            # |c - corner|^2 - |best - corner|^2, above zero if best is strictly nearer even there
            out[:, j] = (toward * (c + best - 2 * corner)).sum(1) <= 0
        return out & may


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if most * most * points.shape[1] < 1 << 51 else np.int64  # whole numbers below 2^53 are exact as doubles
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def _matrix(lists: pa.Array, options: ClusterOptions) -> np.ndarray:
    x = np.floor(options.scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, options.components)
    if len(x) and np.abs(x).max() >= TOO_LARGE:
        raise ValueError(f"a component is {np.abs(x).max() / options.scale:g}; from {TOO_LARGE / options.scale:g} on squared distances do not fit 64 bits")
    return x.astype(np.int64)


def valid_vectors(vectors: DataFrame, options: ClusterOptions, vec_id: str, vector: str) -> DataFrame:
    """(id, v): the vectors with the right number of components, all finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter((F.size(vector) == options.components) & finite).select(F.col(vec_id).alias("id"), v.alias("v"))


def first_centroids(kept: DataFrame, options: ClusterOptions) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order."""
    mark = F.sha2(F.concat(F.lit(f"{options.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(options.clusters).collect()
    return _matrix(pa.array([r.v for r in sorted(rows, key=lambda r: (r.mark, r.v))], pa.list_(pa.float64())), options)


def plant_trees(kept: DataFrame, options: ClusterOptions) -> DataFrame:
    """(ids, tree): kd-trees over blocks of vectors, and the ids in the trees' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, options.block):
                part = b.slice(at, options.block)
                tree = Tree(_matrix(part.column(1), options), options.leaf)
                ids = part.column(0).take(pa.array(tree.order))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([tree.pack()], pa.binary())], names=["ids", "tree"])

    return kept.mapInArrow(run, f"ids array<{kept.schema['id'].dataType.simpleString()}>, tree binary")


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means; those without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            for raw in b.column(0):
                n, s, _, _ = Tree.opened(raw.as_py()).assign(centroids, False)
                numbers += n
                sums += s
        at = np.flatnonzero(numbers)
        width = centroids.shape[1]
        yield pa.RecordBatch.from_arrays([column(np.repeat(at, width).astype(np.int32), pa.int32()), column(np.tile(np.arange(width, dtype=np.int32), len(at)), pa.int32()), column(np.repeat(numbers[at], width), pa.int64()), column(sums[at].ravel(), pa.int64())], names=["c", "d", "n", "s"])

    rows = trees.select("tree").mapInArrow(run, "c int, d int, n long, s long").groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = centroids.copy()
    for r in rows:
        out[r.c, r.d] = r.s // r.n
    return out


def _assigned(trees: DataFrame, centroids: np.ndarray, vec_id: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, _, cluster, distance = Tree.opened(b.column(1)[i].as_py()).assign(centroids, True)
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, column(cluster.astype(np.int32), pa.int32()), column(distance, pa.int64())], names=[vec_id, "cluster", "distance"])

    kind = trees.schema["ids"].dataType.elementType.simpleString()
    return trees.select("ids", "tree").mapInArrow(run, f"`{vec_id}` {kind}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, options: ClusterOptions = ClusterOptions(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): every valid vector with its cluster and what is known of that."""
    spark, staged = vectors.sparkSession, Staged(vectors.sparkSession, "clusters")
    kept = valid_vectors(vectors, options, vec_id, vector)
    centroids = first_centroids(kept, options)
    trees = staged.put(plant_trees(kept, options), "trees", tidy=False)
    for _ in range(options.rounds if len(centroids) else 0):
        centroids = _moved(trees, centroids)
    found = staged.put(_assigned(trees, centroids, vec_id), "assigned", tidy=False)
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(c, s, sum(inertia.values()), centroids[c].tolist()) for c, s in inertia.items()]
    known = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(known), "cluster").select(vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # a row a cluster at most
