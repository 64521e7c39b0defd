"""Language identification by error-correcting output codes.

Each language has a codeword; for each of its bits a logistic model of hashed character n-grams predicts on which side a text is. The
codeword of least weighted loss is chosen, each bit weighing as much as it was right in training. A text whose two best
codewords are close is flagged as ambiguous. See "Solving Multiclass Learning Problems via Error-Correcting Output
Codes" (Dietterich and Bakiri, 1995) and "Loss-Weighted Decoding" (Escalera, Pujol and Radeva, 2006).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewave.llm.store import held_out, keyed_join, small_batches, written
from tidewave.llm.words import spans

DIMS = 1 << 12
#: Texts to learn from at most, in expectation, dealt evenly to the languages; passes over them.
SAMPLE, EPOCHS = 4_000, 40
#: A text is ambiguous if its best codeword's probability is less than this.
CLEAR = 0.8
CHUNK = 1 << 18


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: for up to six classes every way to part them, else rows of a Hadamard matrix, which differ in half their bits."""
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 6:
        return np.array([[1, *x] for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]).T
    order = np.array([[1]])
    while len(order) <= n:
        order = np.block([[order, order], [order, -order]])
    rows = order[1 : n + 1, 1:]
    return rows[:, np.abs(rows.sum(axis=0)) < n]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _cleaned(texts: pa.Array) -> pa.Array:
    """Lower case; ASCII that isn't a letter is a space. Null becomes empty."""
    table = {c: " " for c in range(128) if not chr(c).isalpha()}
    return pa.array([(t or "").lower().translate(table) for t in texts.to_pylist()], pa.large_string())


def grams(texts: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows (texts, DIMS) float32: root frequencies of hashed runs of one to three bytes without repeated spaces, of unit length."""
    raw, offsets = spans(_cleaned(texts))
    i = 0
    while i < len(texts):
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1), i + 256)
        part = raw[offsets[i] : offsets[j]].astype(np.uint32)
        text = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
        keep = np.ones(len(part), bool)
        keep[1:] = (part[1:] != 32) | (part[:-1] != 32)
        part, text = part[keep], text[keep]
        counts = np.zeros((j - i) * DIMS, np.float32)
        for n in (1, 2, 3):
            if len(part) < n:
                continue
            code = np.full(len(part) - n + 1, n, np.uint32)
            for k in range(n):
                code = code * np.uint32(257) + part[k : len(part) - n + 1 + k]
            code *= np.uint32(2654435761)
            inside = text[: len(text) - n + 1] == text[n - 1 :]
            where = text[: len(text) - n + 1] * DIMS + (code >> np.uint32(20))
            counts += np.bincount(where[inside], minlength=len(counts)).astype(np.float32)
        x = np.sqrt(counts.reshape(j - i, DIMS))
        yield x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        i = j


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = np.array(sorted(set(langs)))
        self.codes = codewords(len(self.langs))
        bits = self.codes.shape[1] if len(self.langs) else 1
        self.w, self.b, self.weight = np.zeros((DIMS, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits)
        if len(self.langs) < 2:
            return
        y = self.codes[np.searchsorted(self.langs, langs)].astype(np.float32)
        random, step = np.random.default_rng(3), 0
        gw, gb = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(max(EPOCHS, 2_000 // (len(x) // 64 + 1))):
            for at in np.array_split(random.permutation(len(x)), len(x) // 64 + 1):
                d = -y[at] / (1 + np.exp(np.clip(y[at] * (x[at] @ self.w + self.b), -30, 30))) / max(1, len(at))
                g = x[at].T @ d + 1e-5 * self.w
                gw += g * g
                gb += d.sum(axis=0) ** 2
                self.w -= 0.5 * g / (np.sqrt(gw) + 1e-6)
                self.b -= 0.5 * d.sum(axis=0) / (np.sqrt(gb) + 1e-6)
                step += 1
        right = (np.sign(x @ self.w + self.b) == y).mean(axis=0)
        self.weight = right / max(right.sum(), 1e-9) * bits

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in langs, probabilities) of the nearest codewords."""
        loss = np.stack([(np.logaddexp(0, -(x @ self.w + self.b) * code) * self.weight).sum(axis=1) for code in self.codes], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (probability, double), ambiguous of each document.

    Learned from text and lang of rows that aren't held out and whose lang isn't null. lang_pred is one of the languages learned; it is
    und, with a score of 0, for a null text, a text without letters, and where nothing could be learned. Ties go to the first
    language in order. Rows with a null doc_id are predicted too; rows that repeat a doc_id are learned from and predicted
    each by its own text and lang. Other columns are ignored; no documents give no rows.
    """
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", "lang", "text").filter(~held_out(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = written(known.groupBy("lang").count())
    languages = counts.count()
    share = F.least(F.lit(1.0), F.lit(sample / max(1, languages)) / F.col("count"))
    chosen = keyed_join(known, counts, ["lang"], "inner", languages).filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))
    rows = chosen.select(F.xxhash64("doc_id", "text").alias("order"), "lang", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.empty((0, DIMS), np.float32), *grams(batch.column("text"))]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["order", "lang", "x"])

    rows = rows.mapInArrow(learn, "order long, lang string, x binary").toPandas().sort_values(["order", "lang"])
    model = Model(np.array([np.frombuffer(b, np.float16) for b in rows["x"]], np.float32).reshape(-1, DIMS), rows["lang"].to_numpy(str))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column("text")
            letters = np.fromiter(map(has_letter, texts.to_pylist()), bool, len(texts)) & (len(model.langs) > 0)
            at, p = [], []
            for x in grams(texts) if len(model.langs) else ():
                a, b = model.decode(x)
                at.append(a)
                p.append(b)
            langs = model.langs[np.concatenate(at)].astype(object) if at else np.full(len(texts), None, object)
            score = np.where(letters, np.concatenate(p) if p else 0.0, 0.0).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(letters, langs, "und"), pa.string()), pa.array(score), pa.array(score < CLEAR)], ["doc_id", "lang_pred", "score", "ambiguous"])

    scored = docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")).schema)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
