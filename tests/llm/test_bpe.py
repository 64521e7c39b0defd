"""Encoding and decoding against the library whose file it is, and merging against its definition."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from tidewave.llm import bpe
from tidewave.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Library.from_file(bpe.default_tokenizer())


def merged(symbols, ranks):
    """The least pair by rank, then the leftmost, is merged until there is none."""
    parts = list(symbols)
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = ["".join(parts[i : i + 2])]
    return parts


@pytest.mark.parametrize("seed", range(6))
def test_any_merges(seed, monkeypatch):
    """Random merges over few letters, among them ones that never come about, and windows far shorter than words."""
    r = random.Random(seed)
    names, merges = list("abc"), []
    while len(merges) < 25:
        a, b = r.choice(names), r.choice(names)
        if a + b not in names and len(a + b) <= 9:
            merges.append((a, b))
            names.append(a + b)
    ranks = {m: i for i, m in enumerate(merges)}
    code = bpe.Merges(list("abc"), merges, {c: c for c in "abc"})
    monkeypatch.setattr(bpe, "WINDOW", r.choice([1, 5, 64]))
    for _ in range(300):
        word = "".join(r.choice("aaabc") for _ in range(r.randint(1, 40)))
        assert [code.names[i] for i in code.encode(word)] == merged(word, ranks)


def test_two_ways_to_one_token_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges(list("abc"), [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], {c: c for c in "abc"})


def odd_texts():
    r = random.Random(7)
    pool = list("aaabbeeesthinrgo'ss 12<>|ΣςσİÉé́ͅßǅﬃ​\xa0　中文한국어😀\x00\x1c\x85\t\n᫏ᷗꟋՠ") + ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "\U00010d50"]
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(1500)]


def test_texts_as_the_library(spark, library):
    """Characters that the two sides know from different years, special tokens, an empty and null text, repeated rows, and names that clash."""
    texts = [None, "", " ", "same", "same", "A" * 100_001, "lower the tide " * 20_000, *odd_texts()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "decoded": F.lit(1)}).repartition(3)
    out = {r.doc_id: r for r in bpe.decode(bpe.encode(df)).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].decoded == library.decode(ids, skip_special_tokens=False) and out[i].text == text
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0


def test_ids_without_tokens(spark):
    df = spark.createDataFrame([(1, [320, -1, 10**6, None, 321]), (2, []), (3, None)], "k int, ids array<int>")
    out = {r.k: r.decoded for r in bpe.decode(df).collect()}
    names = {i: t for t, i in Library.from_file(bpe.default_tokenizer()).get_vocab().items()}
    assert out == {1: f"{names[320]} {names[321]}", 2: "", 3: ""}
    digest = {r.k: r.d for r in df.filter("k > 1").select("k", bpe.id_digest(F.col("ids")).alias("d")).collect()}
    assert digest == dict.fromkeys((2, 3), hashlib.sha256(b"").hexdigest())


def test_chunks_and_a_full_memory_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 40)
    monkeypatch.setattr(bpe, "WORDS", 5)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    code = bpe.Tokenizer(bpe.default_tokenizer())
    for text in odd_texts()[:300] + ["unbroken" * 50 + " and\nthen some words, more words " * 9]:
        assert code.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_over_all_documents(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_bpe"](spark, DATA).collect()
    assert len(rows) == len(texts)
    ids = dict(zip(texts, (e.ids for e in library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False))))
    for r in rows:
        own = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
