"""Near-duplicate embeddings by lattice hashing.

In each of several tables a vector's random projections are decoded to a point of E8 per eight dimensions; it is put into the
cell of that point and into those of the neighbouring points it is nearest to. Vectors that share a cell are compared by
cosine in double precision. A pair that shares several cells counts in the first of them only, so links are
counted without being listed; cells with many vectors are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewave.llm.e8 import NEIGHBOURS, nearest
from tidewave.llm.graph import components
from tidewave.llm.store import written
from tidewave.llm.words import mix, randoms

#: Tables, lattice blocks of eight projections in each, neighbouring cells that are probed in each, and lattice steps in a unit of length.
TABLES, BLOCKS, PROBES, SCALE = 8, 3, 4, 4.5
#: Vectors that are compared with as many others at once.
BLOCK = 400


def _plane(dim: int, table: int, blocks: int) -> np.ndarray:
    """Orthonormal directions where there are enough dimensions."""
    gauss = np.random.default_rng([dim, table]).normal(size=(dim, 8 * blocks))
    return np.linalg.qr(gauss)[0] if dim >= 8 * blocks else gauss / np.sqrt(dim)


def cell_codes(unit: np.ndarray, salt: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS) -> np.ndarray:
    """(rows, tables * (1 + PROBES)) uint64: the cells of unit vectors of one length, apart for each salt."""
    out = []
    for table in range(tables):
        x = unit @ (_plane(unit.shape[1], table, blocks) * SCALE * np.sqrt(unit.shape[1] / 64))
        home = np.concatenate([nearest(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        off = x - home
        reach = np.concatenate([off[:, 8 * b : 8 * b + 8] @ NEIGHBOURS.T for b in range(blocks)], axis=1)
        best = np.argpartition(-reach, PROBES - 1, axis=1)[:, :PROBES]
        points = np.repeat(home[:, None], 1 + PROBES, axis=1)
        for p in range(PROBES):
            block, step = best[:, p] // len(NEIGHBOURS), NEIGHBOURS[best[:, p] % len(NEIGHBOURS)]
            for b in range(blocks):
                points[block == b, 1 + p, 8 * b : 8 * b + 8] += step[block == b]
        whole = np.rint(points * 2).astype(np.int64).view(np.uint64)
        out.append(mix((whole * (randoms(8 * blocks, 31) | np.uint64(1))).sum(axis=2) + mix(salt + np.uint64(table))[:, None]))
    return np.concatenate(out, axis=1)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(which rows are usable, their lengths, the usable vectors by length)."""
    column = column.cast(pa.list_(pa.float64()))
    offsets, values = np.asarray(column.offsets), np.asarray(column.values.fill_null(np.nan)) if len(column.values) else np.empty(0)
    size = np.diff(offsets)
    size[np.asarray(column.is_null())] = 0
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    some = np.append(0, np.cumsum((values != 0) & np.isfinite(values)))
    good = (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]])
    return good, size, {d: values[offsets[:-1][good & (size == d)][:, None] + np.arange(d)] for d in np.unique(size[good])}


def vectors(rows: DataFrame, tables: int = TABLES, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, k1, k2, unit, cells) of the rows that can link: k1 and k2 are a digest of label and vector; unit and cells hold doubles and
    64-bit codes in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, size, found = _rows(batch.column("embedding"))
            ids, labels = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label"))
            for dim, x in found.items():
                at = good & (size == dim)
                x = x + 0.0  # no negative zeros
                x /= np.abs(x).max(axis=1, keepdims=True)
                salt = mix(labels[at].astype(np.int64).view(np.uint64) + randoms(1, dim))
                bits = mix(x.view(np.uint64))
                k = [mix((bits * (randoms(dim, s) | np.uint64(1))).sum(axis=1) ^ salt).view(np.int64) for s in (41, 42)]
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                codes = cell_codes(unit, salt, tables, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(k[0]), pa.array(k[1]), pa.array([v.tobytes() for v in unit], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "k1", "k2", "unit", "cells"])

    usable = rows.filter("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return usable.mapInArrow(run, "vec_id long, k1 long, k2 long, unit binary, cells binary")


def _compare(ids: np.ndarray, weight: np.ndarray, unit: np.ndarray, cells: np.ndarray, side: np.ndarray, cell: np.uint64, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the vectors of one cell, how many others each links with that no earlier cell has counted, and the least place that links lead to.
    side: the block of each vector; where there are two, only pairs across them count."""
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    if side.min() != side.max():
        near &= side[:, None] != side[None, :]
    if not near.any():
        return np.zeros(len(ids), np.int64), np.arange(len(ids))
    at, which = np.nonzero(cells < cell)
    values, code, count = np.unique(cells[at, which], return_inverse=True, return_counts=True)
    often = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[often] = np.arange(len(often))
    holds = np.zeros((len(ids), len(often)), np.float32)
    keep = place[code] >= 0
    holds[at[keep], place[code[keep]]] = 1
    first = near & (holds @ holds.T == 0) if len(often) else near
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return (first * weight[None, :]).sum(axis=1), label
        label = low


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, degree, root) for vectors of classes (vec_id, weight, unit, cells): partial sums of links, and vectors that links lead to."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.unique(np.frombuffer(c.as_buffer(), np.uint64)) for c in batch.column("cells")]
            n = np.fromiter(map(len, codes), int, len(codes))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("vec_id")), n)), pa.array(np.concatenate(codes).view(np.int64) if codes else np.empty(0, np.int64))], ["vec_id", "cell"])

    spots = classes.select("vec_id", "cells").mapInArrow(emit, "vec_id long, cell long")
    full = spots.groupBy("cell").count().filter("count > 1").select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    spots = spots.join(full, "cell").withColumn("own", F.pmod(F.xxhash64("vec_id", "cell"), F.col("blocks")).cast("int"))
    spots = spots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spots = written(spots.select("vec_id", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in _and_end(batches):
            table = pa.Table.from_batches([x for x in (left, batch) if x is not None])
            if not len(table):
                continue
            table = table.combine_chunks()
            key = np.stack([np.asarray(table.column(c)) for c in ("cell", "i", "j")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            cuts = np.concatenate([[0], cuts, [len(table)]])
            if batch is not None:  # the last group may go on in the next batch
                left = table.slice(int(cuts[-2])).combine_chunks().to_batches()[0]
                cuts = cuts[:-1]
            ids, weight, side = (np.asarray(table.column(c)) for c in ("vec_id", "weight", "own"))
            out = [[], [], []]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2:
                    continue
                unit = [np.frombuffer(x.as_buffer()) for x in table.column("unit").slice(a, b - a)]
                for dim in {len(x) for x in unit}:
                    pick = a + np.array([k for k, x in enumerate(unit) if len(x) == dim])
                    cells = np.stack([np.frombuffer(table.column("cells")[int(k)].as_buffer(), np.uint64) for k in pick])
                    degree, root = _compare(ids[pick], weight[pick], np.stack([unit[k - a] for k in pick]), cells, side[pick], key[0, a : a + 1].view(np.uint64)[0], threshold)
                    some = (degree > 0) | (root != np.arange(len(pick)))
                    for k, v in enumerate((ids[pick][some], degree[some], ids[pick][root][some])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], ["vec_id", "degree", "root"])

    placed = spots.join(classes, "vec_id").select("cell", "i", "j", "own", "vec_id", "weight", "unit", "cells")
    return placed.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "vec_id").mapInArrow(run, "vec_id long, degree long, root long")


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def embedding_duplicates(rows: DataFrame, threshold: float = 0.98, tables: int = TABLES, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of rows (vec_id, embedding, label): vec_id, n_links (other vectors linked directly), component_id (the smallest
    vec_id that links lead to, itself included), kept (vec_id = component_id).

    Two vectors that have nothing in common share a cell with a probability that falls by a few hundred with each block of eight projections, and pairs
    to compare grow with that share (1e-6 for three blocks) of the square of the rows: give more blocks, and tables to make up for them, to many billions. Only
    equal labels link, by a cosine of threshold or more. Null labels, and vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; vectors of different lengths do not link. Positive multiples of one vector are
    one class, each copy counts as a vector. Rows with a null vec_id link with nothing and are not kept; rows that repeat a vec_id are vectors of
    their own, and each gets the most links and the least component of them. Other columns are ignored; no rows give none.
    """
    found = written(vectors(rows, tables, blocks))
    classes = written(found.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"), F.first("cells").alias("cells")))
    near = written(links(classes.select("vec_id", "weight", "unit", "cells"), threshold))
    degree = near.groupBy("vec_id").agg(F.sum("degree").alias("degree"))
    label = components(near.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "vec_id")
    known = written(classes.select("k1", "k2", "vec_id", "weight").join(degree, "vec_id", "left").join(label, "vec_id", "left").select("k1", "k2", (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    of = written(found.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")))
    all_ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    component = F.coalesce("component_id", "vec_id")
    return all_ids.join(of, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
