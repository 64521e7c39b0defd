"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate and L1 keeps most weights at zero, so the weights that are broadcast are few. See "Ad Click
Prediction: a View from the Trenches" (McMahan et al., 2013). Training runs in shards whose states are averaged
(iterative parameter mixing).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewave.llm.store import held_out, keyed_join, small_batches, written
from tidewave.llm.words import hashed, mix

BITS = 22
#: Labelled rows to learn from at most, in expectation: a sample by hash of what is labelled. Rows of a shard, and passes over each.
SAMPLE, SHARD, PASSES = 16_000, 8_000, 4
#: A coordinate is learned from if so many documents of the shard have it.
INCLUDED = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.5, 0.01
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def features(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and texts of the words, word pairs, and pairs with one or two words between, of some texts (with repeats)."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    codes, texts = [words], [text]
    for gap, salt in ((1, _PAIR), (2, _SKIP), (3, np.uint64(0xA5CB9243D0C5C9A1))):
        if len(words) > gap:
            inside = text[:-gap] == text[gap:]
            codes.append((words[:-gap] * salt + words[gap:] * np.uint64(gap * 2 + 1))[inside])
            texts.append(text[:-gap][inside])
    return (mix(np.concatenate(codes)) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(texts)


def by_text(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct coordinates of each text."""
    for _, words, ends in hashed(texts):
        codes, text = features(words, ends)
        flat = np.unique((text << BITS) | codes)
        cuts = np.searchsorted(flat, np.arange(len(ends), dtype=np.int64) << BITS)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield flat[a:b] & ((1 << BITS) - 1)


def _weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _in_place(table: pa.Table) -> pd.DataFrame:
    """A shard's rows, whose codes are buffers that lie in Arrow's memory: no copy."""
    codes = []
    for chunk in table.column("codes").cast(pa.large_binary()).chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = chunk.buffers()[2] or pa.py_buffer(b"")  # none where all are empty
        codes += [data.slice(int(a), int(b - a)) for a, b in zip(ends[:-1], ends[1:])]
    return table.select(["doc_id", "order", "label"]).to_pandas().assign(codes=codes)


def _shard(rows: pd.DataFrame, only: np.ndarray | None, l1: float) -> pd.DataFrame:
    """FTRL's state (z, n) after PASSES over a shard, where its weight isn't zero. The last coordinate is the bias."""
    rows = rows.sort_values(["doc_id", "order"]).drop_duplicates("doc_id")  # of an id's several texts one
    docs = [np.frombuffer(x, np.int32) for x in rows["codes"]]
    if only is None:
        count = np.zeros(1 << BITS, np.uint16)
        for x in docs:
            count[x] += count[x] < INCLUDED
        included = np.flatnonzero(count >= INCLUDED)
        del count
    else:
        included = np.sort(only[only < 1 << BITS])
    # coordinates that are learned from, numbered; the last one is the bias
    docs = [np.append(_places(included, x), len(included)).astype(np.int32) for x in docs]
    z, n = np.zeros(len(included) + 1), np.zeros(len(included) + 1)
    labels = rows["label"].to_numpy(float)
    for k in range(PASSES):
        for d in np.random.default_rng(k).permutation(len(docs)):
            at = docs[d]
            w = _weights(z[at], n[at], l1)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[d]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    at = np.flatnonzero(np.abs(z) > l1)
    return pd.DataFrame({"at": np.append(included, 1 << BITS)[at], "z": z[at], "n": n[at]})


def _places(among: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in a sorted array of those of x that it holds."""
    if not len(among):
        return np.empty(0, np.int64)
    at = np.searchsorted(among, x)
    at[at == len(among)] = 0
    return at[among[at] == x]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that aren't zero, learned from labelled rows (doc_id, label) that aren't held out. The coordinate 1 << BITS is the bias.

    A first run with L1 chooses the coordinates, those of a nonzero weight in any shard; a second one, without it, weighs those alone, so that what L1 takes from each
    weight does not hide a document with one toxic word. Rows whose text, label or id is null are not learned from; of an id
    that has several labels the least counts, of several texts one by hash. Without any labels, all weights are zero.
    """
    small_batches(docs.sparkSession)
    known = written(labels.filter(~held_out(5, 0) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label")))
    total = known.count()
    part = min(1.0, sample / max(total, 1))
    chosen = written(known.filter(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30)) < int(part * (1 << 30))))
    shards = max(1, -(-min(total, sample) // SHARD))

    rows = keyed_join(docs.filter(F.col("text").isNotNull()).select("doc_id", "text"), chosen, ["doc_id"], "inner").select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("order"), "label", "text")

    def trained(only: np.ndarray | None, l1: float) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = by_text(batch.column("text"))
                codes = codes if only is None else (x[np.isin(x, only)] for x in codes)
                codes = pa.array([x.astype(np.int32).tobytes() for x in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "order", "label")), codes], ["doc_id", "order", "label", "codes"])

        sharded = rows.mapInArrow(run, "doc_id string, order long, label int, codes binary").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
        return sharded.groupBy("shard").applyInArrow(lambda x: pa.Table.from_pandas(_shard(_in_place(x), only, l1), preserve_index=False), "at long, z double, n double")

    selected = trained(None, L1).select("at").distinct().toPandas()["at"].to_numpy(np.int64)
    merged = trained(selected, 0.0).groupBy("at").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toPandas().sort_values("at")
    return merged["at"].to_numpy(np.int64), _weights(merged["z"].to_numpy(), merged["n"].to_numpy(), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """docs with score (probability of the label, double) and predicted (int: 1 from the threshold on), in place of columns of these names. A null or
    empty text gets the bias's score. Only the text goes to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pa.default_memory_pool().release_unused()  # this worker may have held a shard
        where, weights = sent.value
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[where] = weights
        for texts in batches:
            out = []
            for _, words, ends in hashed(texts):
                codes, text = features(words, ends)
                hit = np.flatnonzero(dense[codes])
                flat = np.unique((text[hit] << BITS) | codes[hit])
                sums = np.bincount(flat >> BITS, dense[flat & ((1 << BITS) - 1)], len(ends) - 1) + dense[-1]
                out.append(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
            yield pa.array(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document. Other columns are ignored; no documents give no rows."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, sample=sample))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
