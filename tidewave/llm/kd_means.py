"""Exact k-means of integer vectors by filtering centroids through kd-trees.

Vectors are cut into blocks, and each block's kd-tree (counts, integer sums, bounding boxes) is built once and written. In a round, the centroids go down all
trees. At a node, the one nearest to the middle of its box is held against the others: one that is farther from every point of the box is
pruned. A node that one centroid is left for is assigned whole, by its count and sums; in a leaf that several are left for, distances decide. Per
task and centroid a single row is shuffled. See "An Efficient k-Means Clustering Algorithm" (Kanungo et al., 2002).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewave.llm.store import byte_batches, discard, small_batches, written

#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 1 << 12, 32
#: Integer components lie within this, so that a squared distance of 512 of them fits a long.
MOST = 1 << 26
#: Products and sums of components below this are exact in double precision.
_EXACT = 1 << 21
_TREE = ["ids", "points", "spans", "children", "low", "high", "sums"]


def scaled(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component x, as longs; null unless there are dims components, none of them null or not finite, and all within MOST."""
    doubles = vector.cast("array<double>")
    whole = F.transform(doubles, lambda x: F.floor(x * scale))
    return F.when((F.size(vector) == dims) & F.forall(doubles, lambda x: x.isNotNull() & (F.abs(x) <= MOST // scale - 1)), whole)


def grown(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, spans, children, low, high, sums) of the kd-tree of x (n, dims): the rows' order, and for each node the span of its rows in that order, its two children (0, 0: a
    leaf), its box and sums. A node is cut at the median of its widest component; one of equal vectors is a leaf."""
    order, spans, children, low, high, sums = np.arange(len(x)), [(0, len(x))], [(0, 0)], [], [], []
    k = 0
    while k < len(spans):
        a, b = spans[k]
        own = x[order[a:b]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        sums.append(own.sum(axis=0))
        wide = int((high[k] - low[k]).argmax())
        if b - a > LEAF and high[k][wide] > low[k][wide]:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, wide], middle)]
            children[k] = (len(spans), len(spans) + 1)
            spans += [(a, a + middle), (a + middle, b)]
            children += [(0, 0), (0, 0)]
        k += 1
    return order, np.array(spans, np.int32), np.array(children, np.int32), np.array(low), np.array(high), np.array(sums)


def filtered(tree: tuple[np.ndarray, ...], z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid of each row of a tree, in the tree's order; rows assigned to each centroid; their sums) for centroids z (k, dims), ties to the smaller number.
    tree: points, spans, children, low, high, sums."""
    points, spans, children, low, high, sums = tree
    nearest, n, total = np.zeros(len(points), np.int32), np.zeros(len(z), np.int64), np.zeros(z.shape, np.int64)
    at, left = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
    norms, number = (z * z).sum(axis=1), np.arange(len(z))
    while len(at):
        middle = (low[at] + high[at]) / 2
        best = np.where(left, norms - 2 * middle @ z.T.astype(float), np.inf).argmin(axis=1)
        away = z[None] - z[best][:, None]  # a corner of the box that lies farthest in this direction is the best for the other centroid
        gain = 2 * (np.where(away > 0, high[at][:, None], low[at][:, None]) * away).sum(axis=2) + norms[best][:, None] - norms
        left &= (gain > 0) | (gain == 0) & (number <= best[:, None])
        one = left.sum(axis=1) == 1
        for k, c in zip(at[one], left[one].argmax(axis=1)):
            nearest[spans[k, 0] : spans[k, 1]] = c
        np.add.at(n, left[one].argmax(axis=1), spans[at[one], 1] - spans[at[one], 0])
        np.add.at(total, left[one].argmax(axis=1), sums[at[one]])
        leaf = ~one & (children[at, 0] == 0)
        if leaf.any():
            many = spans[at[leaf], 1] - spans[at[leaf], 0]
            rows = np.repeat(spans[at[leaf], 0] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            x = points[rows]
            dot = (x.astype(float) @ z.T.astype(float)).astype(np.int64) if max(abs(x).max(), abs(z).max()) < _EXACT else x @ z.T
            nearest[rows] = np.where(np.repeat(left[leaf], many, axis=0), norms - 2 * dot, np.iinfo(np.int64).max).argmin(axis=1)
            np.add.at(n, nearest[rows], 1)
            np.add.at(total, nearest[rows], x)
        below = ~one & ~leaf
        at, left = children[at[below]].ravel().astype(np.int64), np.repeat(left[below], 2, axis=0)
    return nearest, n, total


def _trees(vectors: DataFrame) -> DataFrame:
    """One row for each tree of vectors (id, x): ids in the tree's order, and the tree's arrays as bytes of longs and ints."""
    kind = vectors.schema["id"].dataType.simpleString()

    def row(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        order, spans, children, low, high, sums = grown(x)
        own = ids.take(pa.array(order))
        arrays = [pa.array([a.tobytes()], pa.binary()) for a in (x[order].astype(np.int32), spans, children, low, high, sums)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *arrays], _TREE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                held.append(batch.slice(at, BLOCK))
                n += len(held[-1])
                if n >= BLOCK:
                    yield row(*_matrix(held))
                    held, n = [], 0
        if n:
            yield row(*_matrix(held))

    return vectors.select("id", "x").mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"{c} binary" for c in _TREE[1:]))


def _matrix(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, x = (table.column(c).chunk(0) for c in ("id", "x"))
    return ids, np.asarray(x.flatten()).reshape(len(ids), -1)


def _filtered(batches: Iterator[pa.RecordBatch], z: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, tuple]]:
    """(ids, points, what filtered() says) of each tree."""
    for batch in batches:
        for i in range(len(batch)):
            data = {c: batch.column(c)[i] for c in _TREE}
            spans, children = (np.frombuffer(data[c].as_py(), np.int32).reshape(-1, 2) for c in ("spans", "children"))
            points = np.frombuffer(data["points"].as_py(), np.int32).astype(np.int64).reshape(-1, z.shape[1])
            low, high, sums = (np.frombuffer(data[c].as_py(), np.int64).reshape(-1, z.shape[1]) for c in ("low", "high", "sums"))
            yield data["ids"].values, points, filtered((points, spans, children, low, high, sums), z)


def _moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids at the floor of the mean of the vectors that are nearest to them; those of none stay. As many numbers come to the driver as centroids have."""
    z = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros((len(z), 1 + z.shape[1]), np.int64)
        for _, _, (_, n, total) in _filtered(batches, z):
            every += np.column_stack([n, total])
        if every.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(z), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * every.shape[1], pa.int32()), pa.array(every.ravel()))], ["cluster", "sums"])

    parts = trees.mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "value"))
    sums = {(r.cluster, r["at"]): r.total for r in parts.groupBy("cluster", "at").agg(F.sum("value").alias("total")).collect()}
    return [[sums[c, i + 1] // sums[c, 0] for i in range(len(old))] if sums.get((c, 0)) else old for c, old in enumerate(centroids)]


def _assigned(trees: DataFrame, centroids: list[list[int]], id_column: str) -> DataFrame:
    """(id, cluster, distance) of each vector."""
    z = np.array(centroids, np.int64)
    kind = trees.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, (nearest, _, _) in _filtered(batches, z):
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest), pa.array(((points - z[nearest]) ** 2).sum(axis=1))], [id_column, "cluster", "distance"])

    return trees.mapInArrow(run, f"`{id_column}` {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((id, cluster, distance), (cluster, centroid, n, cluster_inertia, inertia)): each vector's nearest centroid and squared Euclidean distance, and the centroids after some rounds,
    with how many vectors each has and the sum of their distances, and of all.

    Components are floor(scale * x), x as double. Centroids start as the k vectors of smallest SHA-256 (in hex) of "seed:id", a null id as nothing;
    of equal ids, the smaller vector comes first. In each round every vector goes to its nearest centroid (ties: the smaller number), then each centroid that has some to the
    floor of their mean. Left out are null vectors, those that have not exactly dims components, that hold null or non-finite ones, and those with a
    component beyond 2^26 after scaling (2^20 at a scale of 64), whose distances a long may not hold. Fewer than k vectors give as many centroids, none give no rows. Repeated rows
    count each; other columns are ignored. k * dims numbers go to all tasks and to the driver. Inertia that a long can't hold is null.
    """
    session = vectors.sparkSession
    small_batches(session)
    byte_batches(session)
    kept = vectors.select(F.col(id_column).alias("id"), scaled(F.col(vector), dims, scale).alias("x")).filter("x is not null")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.x) for r in kept.orderBy(order, "x").limit(k).select("x").collect()]
    numbers = "cluster int, centroid array<long>"
    if not centroids:
        none = session.createDataFrame([], numbers + ", n long, cluster_inertia long, inertia long")
        return kept.select(F.col("id").alias(id_column), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), none
    trees = written(_trees(kept))
    for _ in range(rounds):
        centroids = _moved(trees, centroids)
    assigned = written(_assigned(trees, centroids, id_column))
    discard(trees)
    sums = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(19,0)")).alias("total")).collect()}
    total = [int(sums[c].total) if c in sums else 0 for c in range(len(centroids))]
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(c, z, sums[c].n if c in sums else 0, fits(total[c]), fits(sum(total))) for c, z in enumerate(centroids)]
    return assigned, session.createDataFrame(rows, numbers + ", n long, cluster_inertia long, inertia long")


def digest(centroid: Column) -> Column:
    """SHA-256 (lowercase hex) of components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
