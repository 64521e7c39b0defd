"""Embedding near duplicates and exact search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.llm import e8, embed_dup, topk
from tidewave.llm.graph import components

ROWS = "vec_id long, embedding array<float>, label int"


def test_e8_decodes_to_the_nearest_point():
    x = np.random.default_rng(0).normal(size=(200, 8)) * 2
    home = e8.nearest(x)
    reach = np.linalg.norm(home[:, None] + e8.NEIGHBOURS[None] - x[:, None], axis=2).min(axis=1)
    assert (np.linalg.norm(x - home, axis=1) <= reach + 1e-12).all() and np.linalg.norm(x - home, axis=1).max() <= 1 + 1e-12
    doubled = np.rint(home * 2)
    assert np.allclose(home * 2, doubled) and (doubled.sum(axis=1) % 4 == 0).all() and len({tuple(v) for v in e8.NEIGHBOURS}) == 240


def clusters(seed, n=12, size=9, dim=64):
    random = np.random.default_rng(seed)
    x = np.repeat(random.normal(size=(n, dim)), size, axis=0)
    return (x + random.normal(size=x.shape) * random.choice([0.05, 0.12, 0.16], size=(len(x), 1))).astype(np.float32)


def brute(ids, x, labels, threshold=0.98):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= threshold) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        low = np.minimum(root, np.where(near, root[None], 1 << 60).min(axis=1))
        if (low == root).all():
            return near.sum(axis=1), root
        root = low


@pytest.mark.parametrize("block", [400, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dup, "BLOCK", block)
    x = clusters(1)
    x = np.concatenate([x, x[:3], x[:2] * 2])
    ids, labels = np.arange(len(x)) * 3, np.append(np.arange(len(x) - 5) // 9 % 4, [0, 0, 0, 0, 1])
    rows = [(int(i), [float(v) for v in row], int(l)) for i, row, l in zip(ids, x, labels)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 64, 1), (1003, [float("nan")] * 64, 1), (1004, [None] * 64, 1), (1005, rows[0][1], None), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (None, rows[0][1], rows[0][2])]
    out = {r.vec_id: r for r in embed_dup.embedding_duplicates(spark.createDataFrame(rows + odd, ROWS).withColumn("component", F.lit("clash"))).collect()}
    n, root = brute(ids, x, labels)
    assert [out[i].n_links for i in ids] == n.tolist() and [out[i].component_id for i in ids] == root.tolist()
    assert all(out[i].n_links == 0 and out[i].kept for i in range(1000, 1006)) and (out[1006].n_links, out[1007].component_id) == (1, 1006) and not out[None].kept
    assert all(out[i].kept == (out[i].component_id == i) for i in ids)


def test_no_vectors(spark):
    assert embed_dup.embedding_duplicates(spark.createDataFrame([], ROWS)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (5, 5), (20, 21), (None, 4)] + [(100 + k, 101 + k) for k in range(40)] + [(500, k) for k in range(501, 520)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in (1, 2, 3, 7, 8, 9)} | {20: 20, 21: 20} | {100 + k: 100 for k in range(41)} | {k: 500 for k in range(500, 520)}


@pytest.mark.parametrize("bucket, low, part", [(32, 8, 1 << 13), (0.01, 8, 1 << 13), (0.01, 3, 6)])
def test_top_k_equals_brute_force(spark, monkeypatch, bucket, low, part):
    """Narrow segments, as shipped; wide ones; and cells of which some have many codes and queries."""
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "LOW", low)
    monkeypatch.setattr(topk, "PART", part)
    monkeypatch.setattr(topk, "ASKED", max(2, part // 3))
    random = np.random.default_rng(3)
    codes = random.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64)
    codes[50:80] = codes[40]
    codes[80:120] = codes[40] ^ (np.int64(1) << random.integers(0, 60, 40))
    rows = [(int(i), int(c)) for i, c in enumerate(codes)] + [(1000, None), (None, 5), (7, int(codes[7]))]
    df = spark.createDataFrame(rows, "id long, code long").withColumn("rank", F.lit("clash"))
    got = {}
    for r in topk.top_k(df, df.filter("id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    for q in range(0, 400, 20):
        d = np.bitwise_count((codes ^ codes[q]).view(np.uint64)).astype(int)
        best = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        assert got[q] == [(k + 1, i, d[i]) for k, i in enumerate(best)]
    few = spark.createDataFrame([(1, 5), (2, 5)], "id long, code long")
    assert [tuple(r) for r in topk.top_k(few, few, 10).orderBy("query_id").collect()] == [(1, 1, 2, 0), (2, 1, 1, 0)]
    assert topk.top_k(few.limit(0), few, 3).count() == 0 and topk.top_k(few, few.limit(0), 3).count() == 0


def test_sign_codes(spark):
    top = -(1 << 63)
    rows = [(1, [1.0] + [-1.0] * 63), (2, [-1.0] * 63 + [1.0]), (3, None), (4, [1.0]), (5, [float("nan")] * 64), (6, [1.0] * 65), (7, []), (8, [float("inf")]), (9, [1.0, None])]
    got = {r.id: r.code for r in spark.createDataFrame(rows, "id long, e array<float>").select("id", topk.sign_codes(F.col("e")).alias("code")).collect()}
    assert got == {1: [top], 2: [1], 3: None, 4: [top], 5: None, 6: [-1, top], 7: None, 8: None, 9: None}


def test_top_k_of_long_codes(spark, monkeypatch):
    """Codes of three words, and some of one, which are compared with their like only."""
    monkeypatch.setattr(topk, "BUCKET", 0.05)
    random = np.random.default_rng(5)
    base = random.integers(-(1 << 63), 1 << 63, (8, 3), dtype=np.int64)
    codes = base[random.integers(0, 8, 200)] ^ (np.int64(1) << random.integers(0, 60, (200, 3)))
    rows = [(int(i), [int(x) for x in c]) for i, c in enumerate(codes)] + [(1000 + i, [int(c[0])]) for i, c in enumerate(codes[:5])]
    df = spark.createDataFrame(rows, "id long, code array<long>")
    got = {}
    for r in topk.top_k(df, df.filter("id % 20 = 0"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.distance))
    for q in range(0, 200, 20):
        d = np.bitwise_count((codes ^ codes[q]).view(np.uint64)).astype(int).sum(axis=1)
        assert got[q] == [(i, d[i]) for i in np.lexsort((np.arange(200), d)) if i != q][:7]
    assert {i for i, _ in got[1000]} == {1001, 1002, 1003, 1004}


def test_all_queries_end_by_the_index(spark):
    """As shipped, on the given vectors: each round looks into fewer cells than there are codes for each query, and the last one leaves none open."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), topk.sign_codes(F.col("embedding")).alias("code"))
    trace, queries = [], rows.filter("id % 20 = 0")
    found = topk.top_k(rows, queries, 10, trace)
    n, all_ = queries.count(), {r.id: r.code[0] for r in rows.collect()}
    assert found.count() == 10 * n and [r for r, *_ in trace] == list(range(len(trace))) and 1 <= len(trace) <= 4
    assert all(left <= n and cells < left * len(all_) / 20 for _, left, cells in trace)
    codes, ids = np.array(list(all_.values()), np.int64).view(np.uint64), np.array(list(all_))
    want = {int(q): sorted((int(d), int(i)) for d, i in zip(np.bitwise_count(codes ^ np.uint64(all_[int(q)] % 2**64)), ids) if i != q)[:10] for q in ids if q % 20 == 0}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    assert got == want


@pytest.mark.parametrize("dim, tables, blocks", [(16, 8, 3), (64, 8, 3), (384, 8, 3), (768, 8, 3), (64, 4, 2)])
def test_recall_at_the_threshold(dim, tables, blocks):
    """Of pairs whose cosine is just 0.98 nearly all share a cell."""
    random = np.random.default_rng(dim)
    x, away = random.normal(size=(2, 1500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    salt = np.zeros(len(x), np.uint64)
    a, b = (embed_dup.cell_codes(z, salt, tables, blocks) for z in (x, y))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) >= 0.99
