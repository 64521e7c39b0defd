"""The manifest against trees and paths built level by level."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewave.llm import merkle
from tidewave.llm.queries import QUERIES

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def tree(nodes):
    """(root, path of each node: a list of (left, right))."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            begin = i // 16 * 16
            path.append(("".join(level[begin:i]), "".join(level[i + 1 : begin + 16])))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_traversal(levels):
    """Every path of full, ragged and lone blocks, with stacks whose size doesn't follow the leaves'."""
    for n in sorted({1, 2, 15, 16, 17, 31, 33, 250, 256, 257, 272, 273, 500, 16**levels - 1, 16**levels}):
        if n <= 16**levels:
            leaves = [H(str(i)) for i in range(n)]
            root, paths = tree(leaves)
            for more in range(len(paths[0]), levels):  # a block of a larger tree: each level is hashed, even of one node
                root, paths = H(root), [p + [("", "")] for p in paths]
            assert merkle.block_root(leaves, levels) == root and list(merkle.traversed(leaves, levels)) == paths
    stack = merkle.Treehash(3)
    assert max(sum(map(len, stack.levels)) for i in range(4096) if stack.push(H(str(i)))) <= 3 * 15


def plain(rows):
    """{doc_id, leaf: (subroot, root, path)} of rows (source, doc_id, leaf)."""
    groups = {}
    for source, doc_id, leaf in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = {}
    for s, top in zip(order, tops):
        for (known, doc_id, leaf), path in zip(sorted(groups[s]), trees[s][1]):
            out.setdefault((s, doc_id if known else None, leaf), []).append((trees[s][0], root, path + top))
    return out


@pytest.mark.parametrize("hot", [700, 4400])
def test_manifest(spark, hot):
    """Hot, small, null and odd sources, repeated and null ids, equal rows, clashing names; a source of one block, and one of two, which a tier of its own joins."""
    rows = [("hot", i, H("hot", str(i))) for i in range(hot)] + [(None, i, H("none", str(i))) for i in range(20)] + [("", 1, H("empty")), ("é", 5, H("e")), ("Z", 5, H("z"))]
    rows += [(f"s{k}", k, H("s", str(k))) for k in range(300)] + [("same", 3, H("same"))] * 40 + [("same", None, H("null")), ("same", 3, H("other"))]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string").withColumns({"path": F.lit("clash"), "root": F.lit(0), "index": F.lit(7), "n": F.lit(8), "key": F.lit("own")}).repartition(5)
    found = merkle.manifest(df, "leaf", "source", "doc_id").collect()
    want, got = plain(rows), {}
    for r in found:
        got.setdefault((r.source, r.doc_id, r.leaf), []).append((r.subroot, r.root, [tuple(x) for x in r.path]))
        assert (r["index"], r.n, r.key) == (7, 8, "own")
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_lone_and_no_leaves(spark):
    df = spark.createDataFrame([("a", 1, H("x"))], "source string, doc_id long, leaf string")
    r = merkle.manifest(df, "leaf", "source", "doc_id").withColumn("h", merkle.path_hash(F.col("path"))).first()
    assert (r.subroot, r.root, r.path, r.h) == (H("x"), H("x"), [], H(""))
    assert merkle.manifest(df.limit(0), "leaf", "source", "doc_id").count() == 0


def test_query_over_odd_documents(spark, tmp_path):
    """Null columns, empty and very long texts, ids that a fifth of is shown with changed texts."""
    rows = [(i, ("Text %d " % i) * (1 + i % 3) if i % 11 else None, "en" if i % 4 else None, ["a", "b", None][i % 3], i if i % 5 else None) for i in range(120)] + [(1000, "", "", "", 0), (1001, "Long É " * 200_000, "fr", "b", 1), (None, "Null", "en", "a", 4), (7, "seven again", "en", "b", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: H(*map(field, (r[0], r[3], r[2], r[4], text)))
    want = plain([(r[3], r[0], leaf(r, r[1])) for r in rows])
    shown = {(r[0], leaf(r, r[1])): leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]) for r in rows}
    by_leaf = {(k[1], k[2]): v[0] for k, v in want.items()}
    found = QUERIES["op11_merkle"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        subroot, root, path = by_leaf[r.doc_id, r.leaf]
        node = shown[r.doc_id, r.leaf]
        for left, right in path:
            node = H(left, node, right)
        assert (r.subroot, r.root, r.folded_root, r.verified) == (subroot, root, node, node == root) and r.proof_sha256 == H(*(x for p in path for x in p))
    assert 5 < sum(not r.verified for r in found) < 50
