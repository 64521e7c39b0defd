"""Each operator against brute force on small inputs, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewave.llm import language, line_dedup, mixing, near_dup, packing, quality, quotes, toxicity
from tidewave.llm.tokens import Encoder
from tidewave.llm.words import hashed

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source=lambda k: "s", lang=lambda k: "en"):
    return spark.createDataFrame([(k, t, lang(k), source(k), len(t or "")) for k, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# words and tokens


def test_words_equal_a_regular_expression():
    texts = ["", None, "  ", "A b\tC\x0bd", "ß É é", "x" * 200 + " " + "X" * 200, "a\x1cb c", "end "]
    hashes = [h for _, words, ends in hashed(pa.array(texts), 8) for a, b in zip(ends[:-1], ends[1:]) for h in [words[a:b].tolist()]]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [WORD.findall(lower(t)) for t in texts]
    assert [len(h) for h in hashes] == [len(w) for w in words]
    known = {}
    for h, w in zip(sum(hashes, []), sum(words, [])):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_token_ids_equal_the_tokenizer(spark):
    path = packing.default_tokenizer()
    texts = ["", None, " a  b \n\n c", "x y　\n z", "<|endoftext|> hi <| x", "a\x0b\x0c b", "  ", "don't  I'll\r\n\tgo", "é" * 100 + "x" * 300, "  x  ", "日本語 テキスト", "a b a b a b"]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()]
    plain, code = Tokenizer.from_file(path), Encoder(path)
    for _ in range(2):
        for t, ids in zip(texts, code.encode(pa.array(texts))):
            assert ids.tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_an_encoder_holds_one_library_and_goes_with_its_task(spark):
    """Texts that begin and end in any way need one library; odd ones load the other. No worker keeps an encoder when its task is over."""
    path = packing.default_tokenizer()
    plain, code = Tokenizer.from_file(path), Encoder(path)
    texts = ["", "a", " a", "a ", "  ", "it's", "\n\n x\t", "é ß", "12345 67", "\U0001f600!", "don't stop\n", "x" * 300, None]
    texts += [a + b + c for a in ("", " ", "\n ", "'ll") for b in ("word", "W0rd's", "\u4f60\u597d", "...") for c in ("", " ", " \t", "\n\n")]
    same = lambda texts: [x.tolist() for x in code.encode(pa.array(texts))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert same(texts) and "tokenizer" not in vars(code)
    assert same(["a\xa0b", "x <|endoftext|> y", *texts]) and "tokenizer" in vars(code)

    def kept(batches):
        from tidewave.llm import tokens

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tokens.encoder.cache_info().currsize] * len(batch))], ["n"])

    assert packing.pack(documents(spark, texts)).count() >= len(texts)
    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").collect()} == {0}


def test_packing_round_trip(spark):
    texts = ["", None, "hello world", "word " * 5000, "hello world"]
    docs = documents(spark, texts).withColumn("start", F.lit("clash")).union(documents(spark, ["hello world"]).withColumn("start", F.lit("clash")))
    rows = packing.pack(docs).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == 1 << r.bucket and r.length <= 2048 for r in rows)
    for k, t in enumerate(texts[1:], 1):
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        ids = sum((r.ids for r in mine), [])
        assert ids == plain.encode(t or "", add_special_tokens=False).ids + [1] and [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids) for r in mine)
    assert packing.pack(empty(spark)).count() == 0 and packing.lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]
    again = packing.pack(docs, keep_ids=False).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.sequence_id) for r in again) == sorted((str(r.doc_id), r.start, r.length, r.sequence_id) for r in rows)


def test_token_ids_of_whole_tables_equal_the_tokenizer(spark):
    path = packing.default_tokenizer()
    texts = [r.text for r in spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").collect()]
    expected = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(ids.tolist() == e.ids for ids, e in zip(Encoder(path).encode(pa.array(texts)), expected))


# lines


def test_boilerplate_lines(spark):
    texts = [f"Menu\nown {k}\n\n Menu \nown {k}" for k in range(10)] + ["Menu", None, "", "lone\n"]
    docs = documents(spark, texts, lambda k: "a" if k < 13 else None).withColumn("line", F.lit("clash"))
    rows = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, "source", ratio=0.5, least=3).collect()}
    assert rows[3].text == "own 3\n\nown 3" and (rows[3].n_lines, rows[3].n_dropped) == (4, 2)
    assert rows[10].text == "" and rows[11].text is None and rows[12].text == "" and rows[13].text == "lone\n"
    kept = line_dedup.drop_boilerplate(docs, "source", ratio=0.95, least=3)
    assert kept.filter("n_dropped > 0").count() == 0
    line_dedup.BROADCAST_LINES, was = 0, line_dedup.BROADCAST_LINES
    try:
        assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs, "source", ratio=0.5, least=3).collect()} == {k: r.text for k, r in rows.items()}
    finally:
        line_dedup.BROADCAST_LINES = was
    assert line_dedup.drop_boilerplate(empty(spark), "source").count() == 0


def test_pages(spark):
    html = "<html><script>var x = '<p>no</p>';</script><nav>Home</nav><p>A &amp; <b>B</b><!-- c --></p></html>"
    rows = [(k, f"http://u@Ex.org:80/{k}", html.replace("B", str(k))) for k in range(12)] + [(12, None, html), (13, "no host", None)]
    out = {r.page_id: r for r in line_dedup.dedup_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[5].host == "ex.org" and out[5].text.split() == ["A", "&", "5"] and (out[5].n_lines, out[5].n_dropped) == (2, 1)
    assert out[12].host is None and "Home" in out[12].text and out[13].text is None


def test_boilerplate_of_small_hosts_goes(spark):
    """Hosts of 5, 20 and 50 pages: a line on more than a tenth of them, and on three at least, goes; one on fewer stays."""
    page = lambda n, k: "".join(f"<p>{x}</p>" for x in ["menu"] * (k < max(3, n // 8)) + ["twice"] * (k < 2) + ["tenth"] * (k < n // 10) + [f"own {n} {k}"])
    rows = [(100 * n + k, f"http://h{n}.org/{k}", page(n, k)) for n in (5, 20, 50) for k in range(n)]
    out = line_dedup.dedup_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in out:
        n, k = divmod(r.page_id, 100)
        assert r.n_dropped == (k < max(3, n // 8)) and r.text.split() == ["twice"] * (k < 2) + ["tenth"] * (k < n // 10) + ["own", str(n), str(k)]
    assert sum(r.n_dropped for r in out) == 3 + 3 + 6


# near duplicates


def brute_components(ids, texts, n, percent):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    def shingles(t):
        w = WORD.findall(lower(t))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets, root = [shingles(t) for t in texts], {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, sets):
        for j, b in zip(ids, sets):
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def mutated(seed, groups=6, size=12, words=60):
    random = np.random.default_rng(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{x}" for x in random.integers(0, 4000, words)]
        for k in range(size):
            copy = list(base)
            for at in random.integers(0, words, int(random.integers(0, 6))):
                copy[at] = f"z{random.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    return texts + [None, "", "  ", "one", "One", "two words", "long " * 5000, "long " * 6000]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    texts = mutated(words)
    docs = documents(spark, texts).withColumn("component", F.lit("clash")).withColumn("id", F.lit(1))
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, words).collect()}
    assert rows == brute_components(range(len(texts)), texts, words, 80)
    kept = near_dup.near_duplicates(docs, words).filter("kept").collect()
    assert all(r.doc_id == r.component_id for r in kept) and len(kept) == len({c for _, c in rows.values()})


@pytest.mark.parametrize("members, seed", [(8, 10)])
def test_near_duplicates_in_large_nodes(spark, monkeypatch, members, seed):
    """Nodes of more members than are compared at once: blocks with pivots, few against the rest, and branching."""
    monkeypatch.setattr(near_dup, "MEMBERS", members)
    monkeypatch.setattr(near_dup, "PIVOTS", 2)
    texts = mutated(seed, 3, 40, 40) + [" ".join([f"p{k}" for k in range(30)] + [f"q{seed}a{j}b{k}" for k in range(12)]) for j in range(30)]
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(documents(spark, texts), 4).collect()}
    assert rows == brute_components(range(len(texts)), texts, 4, 80)


@pytest.mark.parametrize("multiply", [0, 10**9])
def test_pairs_confirmed_at_once_equal_sets(monkeypatch, multiply):
    """By lookups and by matrices alike, in slices of both."""
    for name, value in (("LOOKUP", multiply), ("LOOKUPS", 100), ("WIDTH", 7)):
        monkeypatch.setattr(near_dup, name, value)
    random = np.random.default_rng(2)
    full = [np.unique(random.integers(0, 40, int(random.integers(1, 60)))).astype(np.uint64) for _ in range(60)]
    cuts = np.array([0, 1, 25, 60])
    pairs = np.array([(i, j) for low, high in zip(cuts, cuts[1:]) for i in range(low, high) for j in range(i + 1, high)])
    random.shuffle(pairs)
    a, b = pairs.T
    expected = [100 * len(set(full[i]) & set(full[j])) >= 50 * len(set(full[i]) | set(full[j])) for i, j in pairs]
    assert 0 < sum(expected) < len(expected)
    assert near_dup.alike_by_group(full, a, b, cuts, 50).tolist() == expected
    assert near_dup.alike_by_group(full, a[:0], b[:0], cuts, 50).tolist() == []


def test_near_duplicates_of_a_template(spark):
    """Pages made from one template, all below the threshold, with some copies among them."""
    random = np.random.default_rng(6)
    texts = [" ".join([f"p{k}" for k in range(100)] + [f"q{j}b{k}" for k in range(14)]) for j in range(300)]
    texts += [texts[j] + " end" for j in random.choice(300, 20, replace=False)]
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(documents(spark, texts), 4).collect()}
    assert rows == brute_components(range(len(texts)), texts, 4, 80)


def test_near_duplicates_of_long_sets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SHINGLES", 300)
    texts = mutated(12, 2, 30, 60)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(documents(spark, texts), 4).collect()}
    assert rows == brute_components(range(len(texts)), texts, 4, 80)


def test_recall_at_the_threshold():
    """Pairs of a similarity of exactly 0.8 share a node of some tree, and enough tokens agree, all of 2,000."""
    random = np.random.default_rng(8)
    count = near_dup.trees(0.8, 0.9999999)
    floor = near_dup.COORDINATES * 0.8 - near_dup.DEVIATIONS * (near_dup.COORDINATES * 0.16) ** 0.5
    for _ in range(2000):
        x = random.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = near_dup.signature(np.sort(x[:180])), near_dup.signature(np.sort(x[20:]))
        same = a == b
        assert same.sum() >= floor and same[: near_dup.LEVELS * count].reshape(count, near_dup.LEVELS).all(axis=1).any()


def test_near_duplicates_of_odd_tables(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    assert [tuple(r) for r in near_dup.near_duplicates(documents(spark, [None, ""])).orderBy("doc_id").collect()] == [(0, 0, 0, True), (1, 0, 1, True)]
    twice = documents(spark, ["a b c d e f"]).union(documents(spark, ["a b c d e f"])).unionByName(documents(spark, ["a b c d e f"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dup.near_duplicates(twice).collect()) == [("0", 0, True), ("0", 0, True), ("None", 0, False)]


# mixing


def brute_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while True:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over


@pytest.mark.parametrize("share", [0.5, 1.5, 1.9])
def test_mix(spark, share):
    random = np.random.default_rng(7)
    texts = ["w " * int(n) for n in random.integers(0, 40, 900)] + [None, ""]
    docs = documents(spark, texts, lambda k: [None, "B", "a", "é", "", "big"][min(k % 9, 5)]).withColumn("size", F.lit("clash")).withColumn("rank", F.lit(0))
    out = mixing.mix_sources(docs, share=share)
    rows = out.collect()
    sizes = {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id] or "")) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    expected = brute_targets(sizes, (3, 1, 2), share, 2.0)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and all(r.target == pytest.approx(expected[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - expected[s]) <= 80
    assert sorted(rows) == sorted(mixing.mix_sources(docs.repartition(7), share=share).collect())
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.mix_sources(documents(spark, [None])).first().taken == 0


# classifiers


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()


def labelled(spark, texts, bad):
    docs = documents(spark, texts).withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame([(k, int(bad[k]), int(not bad[k])) for k in range(len(texts))] + [(None, 1, 1), (0, None, None)], "doc_id long, toxic int, quality int")


def test_toxicity_held_out(spark):
    random = np.random.default_rng(1)
    bad = random.random(600) < 0.3
    texts = [" ".join([*(f"w{x}" for x in random.integers(0, 300, 40)), *(["awful", "creature"] if b else ["awful"])]) for b in bad]
    docs, labels = labelled(spark, [*texts, None, "", "word"], [*bad, False, False, False])
    rows = {r.doc_id: r for r in toxicity.toxic(docs, labels).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in rows)
    assert auc([bad[k] for k in held], [rows[k].score for k in held]) > 0.99 and rows[600].score == rows[601].score and rows[600].predicted == 0
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxic(docs, wrong).collect()} == {k: r.score for k, r in rows.items()}
    assert toxicity.toxic(empty(spark), labels).count() == 0 and {r.score for r in toxicity.toxic(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_held_out(spark):
    random = np.random.default_rng(2)
    bad = random.random(400) < 0.3
    texts = [" ".join(f"w{x}!!" if b and random.random() < 0.5 else f"w{x}" for x in random.integers(0, 200, 60)) for b in bad]
    docs, labels = labelled(spark, [*texts, None, ""], [*bad, False, False])
    rows = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert auc([not bad[k] for k in held], [rows[k].score for k in held]) > 0.95 and rows[400].score == rows[401].score
    assert all(r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert quality.quality(empty(spark), labels).count() == 0 and quality.quality(docs, labels.limit(0)).count() == 402


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = documents(spark, [None, "", "123 !!", "ß"], lang=lambda k: None).withColumn("doc_id", F.col("doc_id") + 10**6)
    rows = language.identify(docs.unionByName(extra).withColumn("score", F.lit("clash"))).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    known = [r for r in rows if r.lang]
    held = [r for r in known if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.doc_id)][-4:-1] == ["und"] * 3 and [r.lang_pred for r in rows if r.doc_id == 10**6 + 3] != ["und"]
    assert language.identify(empty(spark)).count() == 0 and language.identify(documents(spark, ["a"], lang=lambda k: None)).first().lang_pred == "und"


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 40])
def test_codewords_are_apart(n):
    codes = language.codewords(n)
    apart = (codes[:, None] != codes[None]).sum(axis=2)[~np.eye(n, dtype=bool)]
    assert apart.min() >= max(1, codes.shape[1] // 4) and (np.abs(codes.sum(axis=0)) < n).all()


# quotations


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there!\nHow is the weather?"),
        (1, 1, "assistant", "It is fine.\nThanks."),
        (1, 2, "user", "Ann wrote this:\n> It is FINE\n>> How is the   weather\nGood to know."),
        (1, 3, "user", "On Monday X wrote:\n> Good to know.\nIndeed."),
        (1, 4, "user", "> never said\nstill here"),
        (2, 0, "user", None),
        (2, 1, "user", "> It is fine.\nother conversation"),
        (3, 0, "user", "same"),
        (3, 1, "user", "same"),
        (3, 2, "user", "> same\nlater one"),
        (None, 0, "user", "> x"),
    ]
    out = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(9))).collect()}
    place = lambda *k: (out[k].parent_turn, out[k].root_turn, out[k].depth, out[k].n_quoted, out[k].n_linked)
    assert place(1, 2) == (1, 1, 1, 2, 2) and out[1, 2].text == "Ann wrote this:\nGood to know."
    assert place(1, 3) == (2, 1, 2, 1, 1) and out[1, 3].text == "Indeed."
    assert place(1, 4) == (None, 4, 0, 1, 0) and out[1, 4].text == "still here"
    assert place(2, 1) == (None, 1, 0, 1, 0) and out[2, 0].text is None and place(3, 2) == (1, 1, 1, 1, 1)
    assert out[1, 0].text == rows[0][3] and out[None, 0].n_quoted == 1 and len(out) == len(rows)
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_groups_are_gathered_in_little_memory():
    """Whole groups, all of them, with no more than a few tables' bytes held at once."""
    from tidewave.llm.blocks import whole_groups

    random, before, most = np.random.default_rng(4), pa.total_allocated_bytes(), [0]

    def batches():
        for k in range(100):
            row = np.arange(64) + 64 * k
            yield pa.RecordBatch.from_arrays([pa.array(row // 7), pa.array(row % 7 // 4), pa.array([random.bytes(1 << 14) for _ in row], pa.binary())], ["node", "block", "found"])
            most[0] = max(most[0], pa.total_allocated_bytes() - before)

    seen = []
    for table, cuts in whole_groups(batches(), ["node", "block"]):
        keys = list(zip(table.column("node").to_pylist(), table.column("block").to_pylist()))
        assert [len(set(keys[a:b])) for a, b in zip(cuts[:-1], cuts[1:])] == [1] * (len(cuts) - 1)
        assert cuts[0] == 0 and cuts[-1] == len(keys)
        seen += [keys[a] for a in cuts[:-1]]
        del table
    assert seen == sorted({(r // 7, r % 7 // 4) for r in range(6400)})
    assert most[0] < 64e6
