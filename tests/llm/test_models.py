"""The classifiers against plain re-computations, one number at a time."""

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_text_operators import DOCS, documents
from tidewave.llm import language, quality, toxicity
from tidewave.llm.words import hashed, mix

TEXTS = ["a b c a d", "", None, "b a", "x", "c c c c a b d e f g", "A  B\tc", "y z " * 200]


def words(text):
    """The hashes of a text's words."""
    return [int(w) for _, hashes, _ in hashed(pa.array([text])) for w in hashes]


def test_word_sums_and_pooling(spark):
    docs = documents(spark, TEXTS * 3)
    place, sign = quality._index()
    expected = np.zeros((quality.BUCKETS, quality.DIM + 1))
    for text in TEXTS * 3:
        b = [int(quality._buckets(np.array([w], np.uint64))[0]) for w in words(text)]
        for i, x in enumerate(b):
            expected[x, quality.DIM] += 1
            for j in range(max(0, i - quality.REACH), min(len(b), i + quality.REACH + 1)):
                if j != i:
                    for k in range(quality.NONZERO):
                        expected[x, place[b[j], k]] += sign[b[j], k]
    sums = quality.word_sums(docs.repartition(3))
    assert np.array_equal(sums, expected)
    vectors = quality.word_vectors(sums)
    total = expected[:, quality.DIM].sum()
    common = expected[:, : quality.DIM].sum(axis=0) / total
    for text, row in zip(TEXTS, quality.pooled(pa.array(TEXTS), vectors)):
        b = [int(quality._buckets(np.array([w], np.uint64))[0]) for w in words(text)]
        unit, weight = [], []
        for x in b:
            v = expected[x, : quality.DIM] / expected[x, quality.DIM] - common
            unit.append(v / np.linalg.norm(v))
            n = expected[x, quality.DIM]
            weight.append(1e-3 / (1e-3 + n / total) * n / (n + quality.SEEN))
        plain = np.zeros(quality.INPUTS)
        if b:
            plain[: quality.DIM] = sum(w * u for w, u in zip(weight, unit)) / sum(weight)
            for gap in range(1, quality.REACH + 1):
                plain[quality.DIM + gap - 1] = sum(unit[i] @ unit[i - gap] for i in range(gap, len(b))) / max(len(b) - gap, 1)
            plain[-1] = math.log1p(len(b))
        assert np.allclose(row, plain, atol=1e-5), text


def test_network_is_two_layers_and_a_temperature():
    random = np.random.default_rng(0)
    x = random.normal(size=(300, quality.INPUTS))
    y = (x[:, 0] + 0.3 * random.normal(size=300) > 0).astype(float)
    net = quality.Network(x, y)
    for row, score in list(zip(x, net.score(x)))[:20]:
        z = (row - net.mean) / net.scale
        hidden = [math.tanh(sum(z[i] * net.w[0][i, j] for i in range(len(z))) + net.w[1][j]) for j in range(quality.HIDDEN)]
        logit = (sum(h * w for h, w in zip(hidden, net.w[2])) + net.w[3][0]) / net.temperature
        assert abs(score - 1 / (1 + math.exp(-logit))) < 1e-9
    assert 0.25 <= net.temperature <= 8 and ((net.score(x) > 0.5) == y).mean() > 0.9


def plain_features(text):
    w, found = words(text), set()
    m, salts = (1 << 64) - 1, {1: 0x9E3779B97F4A7C15, 2: 0xD6E8FEB86659FD93, 3: 0xA5CB9243D0C5C9A1}
    codes = list(w) + [(w[i] * salts[g] + w[i + g] * (2 * g + 1)) & m for g in salts for i in range(len(w) - g)]
    return {int(mix(np.array([c], np.uint64))[0] >> np.uint64(64 - toxicity.BITS)) for c in codes}


def test_hashed_n_grams_and_skip_grams():
    assert [set(x.tolist()) for x in toxicity.by_text(pa.array(TEXTS))] == [plain_features(t) for t in TEXTS]


def plain_ftrl(docs, labels, included, l1):
    """FTRL-proximal, one coordinate at a time."""
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for k in range(toxicity.PASSES):
        for d in np.random.default_rng(k).permutation(len(docs)):
            at = [i for i in docs[d] if i in included] + [1 << toxicity.BITS]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[d]
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: (z[i], n[i]) for i in z if abs(z[i]) > l1}


def test_ftrl_steps_and_scores(spark):
    random = np.random.default_rng(2)
    bad = random.random(60) < 0.4
    texts = [" ".join([*(f"w{x}" for x in random.integers(0, 30, 12)), *["vile"] * int(b)]) for b in bad]
    codes = [sorted(plain_features(t)) for t in texts]
    rows = pd.DataFrame({"doc_id": [f"{k:03}" for k in range(60)], "order": 0, "label": bad.astype(int), "codes": [np.array(c, np.int32).tobytes() for c in codes]})
    often = {i for i in set(sum(codes, [])) if sum(i in c for c in codes) >= toxicity.INCLUDED}
    for only, l1, included in ((None, toxicity.L1, often), (np.array(sorted(often)[::2]), 0.0, set(sorted(often)[::2]))):
        got = {r["at"]: (r["z"], r["n"]) for _, r in toxicity._shard(rows, only, l1).iterrows()}
        expected = plain_ftrl(codes, bad.astype(float), included, l1)
        assert set(got) == set(expected) and all(np.allclose(got[i], expected[i]) for i in got)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(b)) for k, b in enumerate(bad)] + [(0, 1 - int(bad[0]))], "doc_id long, toxic int")
    at, weights = toxicity.fit(docs, labels)
    known = dict(zip(at.tolist(), weights.astype(np.float32).tolist()))
    for r in toxicity.toxic(docs, labels).collect():
        logit = sum(known.get(i, 0.0) for i in plain_features(texts[r.doc_id])) + known.get(1 << toxicity.BITS, 0.0)
        assert abs(r.score - 1 / (1 + math.exp(-logit))) < 1e-5 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_grams_and_loss_weighted_decoding():
    texts = ["Ab, cab!", "", "zz zz", "é1a"]
    for text, row in zip(texts, np.concatenate(list(language.grams(pa.array(texts))))):
        raw = re.sub(r" +", " ", re.sub(r"[\x00-\x40\x5b-\x60\x7b-\x7f]", " ", text.lower())).encode()
        counts = np.zeros(language.DIMS)
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                code = n
                for byte in raw[i : i + n]:
                    code = (code * 257 + byte) % (1 << 32)
                counts[(code * 2654435761 % (1 << 32)) >> 20] += 1
        plain = np.sqrt(counts)
        assert np.allclose(row, plain / max(np.linalg.norm(plain), 1e-9), atol=1e-6)
    random = np.random.default_rng(4)
    x = np.abs(random.normal(size=(90, language.DIMS))).astype(np.float32)
    langs = np.array(["de", "en", "fr"])[np.arange(90) % 3]
    x[np.arange(90), np.arange(90) % 3] += 9
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language.Model(x, langs)
    at, p = model.decode(x)
    for row, best, score in list(zip(x, at, p))[:15]:
        losses = []
        for code in model.codes:
            margins = [code[b] * (float(row @ model.w[:, b]) + float(model.b[b])) for b in range(len(code))]
            losses.append(sum(model.weight[b] * math.log1p(math.exp(-m)) for b, m in enumerate(margins)))
        plain = np.exp(min(losses) - np.array(losses))
        assert best == int(np.argmin(losses)) and abs(score - plain.max() / plain.sum()) < 1e-4
    assert (model.langs[at] == langs).mean() > 0.9


def test_classifiers_of_repeated_and_conflicting_rows(spark):
    """Repeated doc_ids, labels that contradict each other, and a very long text: the same result in every order of the rows."""
    base = [(k, f"w{k % 7} x{k % 5} " + ("vile thing" if k % 3 == 0 else "fine thing"), "en" if k % 2 else "de", "s", 0) for k in range(60)]
    rows = base + base[:10] + [(3, "another text of three", "en", "s", 0), (61, "long vile " * 30000, "en", "s", 0), (None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 != 0)) for k in range(60)] + [(0, 0, 1), (3, 0, 1), (6, None, None)], "doc_id long, toxic int, quality int")
    rounded = lambda df: sorted(repr(tuple(round(x, 5) if isinstance(x, float) else x for x in r)) for r in df.collect())  # noqa: E731  sums in other batches end differently
    for run in (lambda d, x: toxicity.toxic(d, x), lambda d, x: quality.quality(d, x), lambda d, x: language.identify(d)):
        one, other = (rounded(run(d, x)) for d, x in ((docs, labels), (docs.orderBy(F.rand(1)).repartition(3), labels.orderBy(F.rand(2)))))
        assert one == other and len(one) == len(rows)


def test_a_shard_reads_codes_in_place():
    """A shard of Arrow's memory, several chunks of it, gives what its pandas copy gives, and copies no codes."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    part = lambda ids: pa.table({"doc_id": ids, "order": pa.array(rng.integers(0, 99, len(ids))), "label": pa.array(rng.integers(0, 2, len(ids)), pa.int32()), "codes": pa.array([np.unique(rng.integers(0, 60, 25)).astype(np.int32).tobytes() for _ in ids], pa.binary())})
    table = pa.concat_tables([part([str(i) for i in range(30)]), part(["3", "x", "y"])])
    rows = toxicity._in_place(table)
    assert rows["codes"][0].address == table.column("codes").chunk(0).buffers()[2].address
    for only in (None, np.arange(0, 60, 3)):
        got, want = toxicity._shard(rows, only, 0.1), toxicity._shard(table.to_pandas(), only, 0.1)
        assert len(got) and got.equals(want)
