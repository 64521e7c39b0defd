"""Quality by random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Each word has a fixed sparse random index vector; its context vector is the sum of the index vectors of its neighbours over the whole
corpus. Words share BUCKETS rows by hash, a quarter of a million, so the vectors are of fixed size however large the corpus. A document is the mean
of its words' vectors, rare words counting more, how much words one and two places apart are alike, and the logarithm of
their number. The network is fitted by Adam on a bounded sample of labels, and its
temperature on a part of that sample that it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewave.llm.store import held_out, keyed_join, small_batches, written
from tidewave.llm.words import hashed, mix, randoms

BUCKETS, DIM, NONZERO, REACH = 1 << 18, 32, 4, 2
#: Rows of the table of vectors that are summed together.
ROWS = 256
#: A word's vector counts in full if it was seen much more often than this.
SEEN = 8.0
#: Labelled rows to learn from at most, in expectation.
SAMPLE, HIDDEN, EPOCHS = 16_000, 32, 60
INPUTS = DIM + REACH + 1
_SLICE = 1 << 20


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector."""
    code = randoms(BUCKETS * NONZERO, 21).reshape(BUCKETS, NONZERO)
    return (code % np.uint64(DIM)).astype(np.int64), np.where(code >> np.uint64(63), 1, -1).astype(np.int8)


def _buckets(words: np.ndarray) -> np.ndarray:
    return (mix(words ^ np.uint64(0x51ED270B)) >> np.uint64(64 - 18)).astype(np.int64)


def _neighbour_sums(b: np.ndarray, text: np.ndarray, place: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, sums): of the words of some texts, the sums of the index vectors of their neighbours, and how often they occur."""
    used, at = np.unique(b, return_inverse=True)
    sums = np.zeros((len(used), DIM + 1), np.int32)
    sums[:, DIM] = np.bincount(at, minlength=len(used))
    for gap in range(1, REACH + 1):
        near = np.flatnonzero(text[:-gap] == text[gap:]) if len(b) > gap else np.zeros(0, np.int64)
        for x, y in ((near, near + gap), (near + gap, near)):
            for k in range(NONZERO):
                sums[:, :DIM] += np.bincount(at[x] * DIM + place[b[y], k], sign[b[y], k], len(used) * DIM).astype(np.int32).reshape(-1, DIM)
    return used, sums


def word_sums(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM + 1): sums of the index vectors of neighbours, and how often each bucket's words occur, over all texts. A task sends the rows of the
    buckets that it has seen, and the driver gets the one table of fixed size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index()
        total = np.zeros((BUCKETS, DIM + 1), np.int32)
        for batch in batches:
            for _, words, ends in hashed(batch.column(0), _SLICE):
                used, sums = _neighbour_sums(_buckets(words), np.repeat(np.arange(len(ends) - 1), np.diff(ends)), place, sign)
                total[used] += sums
        seen = np.flatnonzero(total[:, DIM])
        small = (np.abs(total[seen]) < 128).all(axis=1)  # nearly all: a byte each
        for rows, kind in ((seen[small], np.int8), (seen[~small], np.int32)):
            for at in np.array_split(rows, len(rows) // 8192 + 1):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array((at // ROWS).astype(np.int32)), pa.array((at % ROWS).astype(np.int32)), pa.array([x.tobytes() for x in total[at].astype(kind)], pa.binary())], ["part", "row", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            part, row = np.asarray(batch.column("part")), np.asarray(batch.column("row"))
            size = np.asarray(pc.binary_length(batch.column("sums")))
            for kind in (np.int8, np.int32):
                at = np.flatnonzero(size == (DIM + 1) * np.dtype(kind).itemsize)
                if len(at):
                    x = np.frombuffer(b"".join(batch.column("sums")[int(i)].as_buffer() for i in at), kind).reshape(-1, DIM + 1)
                    for p in np.unique(part[at]):
                        mine = part[at] == p
                        np.add.at(sums.setdefault(int(p), np.zeros((ROWS, DIM + 1), np.int64)), row[at][mine], x[mine])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["part", "sums"])

    found = docs.select("text").mapInArrow(partial, "part int, row int, sums binary").repartition("part").mapInArrow(add, "part int, sums binary").collect()
    total = np.zeros((BUCKETS // ROWS, ROWS, DIM + 1), np.float32)
    for row in found:
        total[row["part"]] = np.frombuffer(row["sums"], np.float32).reshape(ROWS, DIM + 1)
    return total.reshape(BUCKETS, DIM + 1)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """(BUCKETS, DIM + 1) float32: unit vectors, and the weight of the word: less the commoner it is, and less if it was hardly seen."""
    count = sums[:, DIM].astype(float)
    vectors = sums[:, :DIM] / np.maximum(count, 1).astype(np.float32)[:, None]
    vectors -= (sums[:, :DIM].sum(axis=0, dtype=float) / max(count.sum(), 1)).astype(np.float32)  # what all words have in common tells nothing
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    vectors[count == 0] = 0
    share = 1e-3 / (1e-3 + count / max(count.sum(), 1))
    return np.column_stack([vectors, (share * count / (count + SEEN)).astype(np.float32)])


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(texts, INPUTS) from the words' vectors; zeros without words."""
    out = [np.zeros((0, INPUTS))]
    for _, words, ends in hashed(texts):
        n = np.diff(ends)
        x = np.zeros((len(n), INPUTS))
        full = np.flatnonzero(n)
        if len(full):
            first = ends[:-1][full]
            rows = vectors[_buckets(words)]
            unit, weight = rows[:, :DIM], rows[:, DIM]
            x[full, :DIM] = np.add.reduceat(unit * weight[:, None], first, axis=0) / np.maximum(np.add.reduceat(weight, first), 1e-9)[:, None]
            text = np.repeat(np.arange(len(n)), n)
            for gap in range(1, REACH + 1):
                alike = np.zeros(len(words))
                if len(words) > gap:
                    alike[gap:] = np.einsum("ij,ij->i", unit[gap:], unit[:-gap]) * (text[gap:] == text[:-gap])
                x[full, DIM + gap - 1] = np.add.reduceat(alike, first) / np.maximum(n[full] - gap, 1)
            x[full, -1] = np.log1p(n[full])
        out.append(x)
    return np.concatenate(out)


class Network:
    """tanh layer, then a logit, divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        random = np.random.default_rng(5)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(INPUTS), np.ones(INPUTS))
        self.temperature = 1.0
        w = [random.normal(size=(INPUTS, HIDDEN)) / np.sqrt(INPUTS), np.zeros(HIDDEN), random.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        self.w = w
        if not len(x):
            return
        share = np.clip(y.mean(), 0.01, 0.99)
        w[3][0] = np.log(share / (1 - share))
        check = random.random(len(x)) < 0.2 if len(x) >= 50 else np.zeros(len(x), bool)
        fit, x = np.flatnonzero(~check), (x - self.mean) / self.scale
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(max(EPOCHS, 20_000 // max(1, len(fit) // 64 + 1) // 8)):
            for at in np.array_split(random.permutation(fit), len(fit) // 64 + 1):
                h = np.tanh(x[at] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3][0], -35, 35))) - y[at]) / max(1, len(at))
                back = d[:, None] * w[2] * (1 - h * h)
                step += 1
                for k, g in enumerate((x[at].T @ back, back.sum(axis=0), h.T @ d, np.array([d.sum()]))):
                    g = g + 3e-4 * w[k] * (k in (0, 2))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] -= 5e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if check.any():
            logit, seen = self._logit(x[check]), y[check]
            loss = lambda t: np.logaddexp(0, -np.where(seen > 0, 1, -1) * logit / t).mean()
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -35, 35)))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (probability of the label 1, double), predicted (int: 1 from the threshold on) of each document.

    Word vectors come from all texts, labels only from rows that aren't held out. A null or empty text is the mean of no words and gets the
    network's score of zeros. Without labels every score is 0.5 or so. Null labels, ids and texts are not learned from;
    of an id that has several labels the least counts, of several texts one by hash. Other columns are ignored; no documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vectors = word_vectors(word_sums(docs))
    sent = spark.sparkContext.broadcast(vectors)
    known = written(labels.filter(~held_out(4, 2) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label")))
    part = min(1.0, sample / max(known.count(), 1))
    chosen = written(known.filter(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30)) < int(part * (1 << 30))))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "order", "label")), pa.array([x.tobytes() for x in pooled(batch.column("text"), sent.value)], pa.binary())], ["doc_id", "order", "label", "x"])

    rows = keyed_join(docs.filter(F.col("text").isNotNull()).select("doc_id", "text"), chosen, ["doc_id"], "inner").select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("order"), "label", "text")
    rows = rows.mapInArrow(pool, "doc_id string, order long, label int, x binary").toPandas().sort_values(["doc_id", "order"]).drop_duplicates("doc_id")
    x = np.array([np.frombuffer(b) for b in rows["x"]]).reshape(-1, INPUTS)
    network = Network(x, rows["label"].to_numpy(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(network.score(pooled(batch.column("text"), sent.value)))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", F.lit(0.0).alias("score")).schema)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
