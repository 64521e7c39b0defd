"""k-means through kd-trees against plain assignments to all centroids."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.llm import kd_means


@pytest.mark.parametrize("dims, n, spread", [(64, 1500, 8), (2, 700, 3), (1, 400, 2), (16, 300, 0), (8, 1, 5)])
def test_filtering_is_exact(dims, n, spread):
    """Also with ties, equal centroids and equal vectors."""
    random = np.random.default_rng(dims)
    for k in (1, 7, 16):
        x = (random.normal(size=(n, dims)) * spread).astype(np.int64) + random.integers(0, 4, (n, 1)) * 3 * spread
        z = x[random.integers(0, n, k)] + random.integers(0, 2, (k, 1))
        order, *tree = kd_means.grown(x)
        nearest, count, total = kd_means.filtered((x[order], *tree), z)
        want = ((x[order][:, None] - z[None]) ** 2).sum(axis=2).argmin(axis=1)
        sums = np.zeros_like(z)
        np.add.at(sums, want, x[order])
        assert (nearest == want).all() and (count == np.bincount(want, minlength=k)).all() and (total == sums).all()


def test_far_vectors_are_exact():
    """Components at the bound, whose products no double holds."""
    random = np.random.default_rng(1)
    x = random.integers(-kd_means.MOST, kd_means.MOST, (300, 64))
    z = x[:9] + 1
    order, *tree = kd_means.grown(x)
    want = [min(range(9), key=lambda c: (sum((int(a) - int(b)) ** 2 for a, b in zip(v, z[c])), c)) for v in x[order]]
    assert kd_means.filtered((x[order], *tree), z)[0].tolist() == want


def plain(vectors, k, rounds, scale):
    """(cluster, distance) by id, and the centroids, in Python's integers."""
    kept = {i: tuple(int(np.floor(scale * x)) for x in v) for i, v in vectors}
    order = sorted(kept, key=lambda i: (hashlib.sha256(f"1:{i}".encode()).hexdigest(), kept[i]))
    z = [kept[i] for i in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(z))
    for _ in range(rounds):
        groups = {}
        for v in kept.values():
            groups.setdefault(nearest(v)[1], []).append(v)
        z = [tuple(sum(c) // len(groups[n]) for c in zip(*groups[n])) if n in groups else old for n, old in enumerate(z)]
    return {i: nearest(v)[::-1] for i, v in kept.items()}, z


@pytest.mark.parametrize("block", [1 << 12, 50])
def test_clusters_equal_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(kd_means, "BLOCK", block)
    monkeypatch.setattr(kd_means, "LEAF", 4)
    random = np.random.default_rng(4)
    x = random.normal(size=(400, 6)) + random.integers(0, 5, (400, 1)) * 2
    x[100:180] = x[100]  # a group of copies, of which several may start
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [float("nan")] * 6), (905, [1.0] * 5 + [None]), (906, [float("-inf")] * 6), (907, [1e30] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("clash"), "id": F.lit(1), "x": F.lit(2)}).repartition(3)
    assigned, centroids = kd_means.cluster(df, k=5, rounds=3, dims=6, scale=16)
    want, z = plain(rows, 5, 3, 16)
    assert {r.vec_id: (r.cluster, r.distance) for r in assigned.collect()} == want
    total = sum(d for _, d in want.values())
    for r in centroids.withColumn("h", kd_means.digest(F.col("centroid"))).collect():
        own = [d for c, d in want.values() if c == r.cluster]
        assert (tuple(r.centroid), r.n, r.cluster_inertia, r.inertia) == (z[r.cluster], len(own), sum(own), total) and r.h == hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest()


def test_few_repeated_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [-3.0, 0.5])], "vec_id long, embedding array<float>")
    assigned, centroids = kd_means.cluster(df, dims=2)
    assert assigned.count() == 3 and centroids.count() == 3 and {(r.vec_id, r.distance) for r in assigned.collect()} == {(1, 0), (None, 0)}
    assigned, centroids = kd_means.cluster(df.limit(0), dims=2)
    assert assigned.columns == ["vec_id", "cluster", "distance"] and assigned.count() == centroids.count() == 0
