"""The stages, and that the whole runs end to end."""

import hashlib
import math

import corpus_pipeline
import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm.test_text_operators import WORD, brute_components, brute_targets
from tidewave.llm import packing, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() > 0, name


def test_run_packs_whole_documents(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_doc.values():
        assert sum(p.length for p in pieces) % pieces[0].doc_tokens == 0 and all(len(p.ids) == p.length for p in pieces)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    texts = [f"w{k} plain words of no harm {k}" for k in range(200)] + [f"w{k} you vile troll {k}" for k in range(60)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    import tempfile

    d = tempfile.mkdtemp()
    spark.createDataFrame([(k, 1, int(k >= 200)) for k in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, d).collect()) == list(range(200))


def test_passages_shared_by_few_of_a_source_go(spark):
    """Passages on 1.2 to 5 % of a source with half of all rows, and of small ones; copies of a document are not boilerplate."""
    rows, passage = [], lambda source, share: " ".join(f"{source}{share}w{j}" for j in range(60))
    for source, n in (("hot", 1000), ("small", 250), ("tiny", 60)):
        for k in range(n):
            shared = [passage(source, share) for share in (12, 20, 50) if k < max(3, n * share // 1000 + 1)]
            rows.append((len(rows), "\n".join([f"own {source} {k}", *shared, passage(source, "pair")] if k < 2 else [f"own {source} {k}", *shared]), "en", source, 0))
    rows += [(len(rows) + k, "copied first line\ncopied second line", "en", "small", 0) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.drop_lines(spark, docs, DATA).collect()}
    assert len(out) == len(rows)
    for doc_id, text, _, source, _ in rows:
        own = [x for x in text.split("\n") if x.startswith(("own", "copied")) or x == passage(source, "pair")]
        assert out[doc_id].text == "\n".join(own) and out[doc_id].n_chars == len(out[doc_id].text)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(name, n=30):
    return " ".join(f"{name}{j}" for j in range(n))


def test_near_duplicates_of_rows_with_null_and_repeated_ids(spark):
    near = words("a", 39)
    texts = [(1, words("a", 40)), (2, near), (2, words("own")), (3, words("twice")), (3, words("twice")), (None, words("a", 40)), (None, words("null")), (None, words("null")), (4, words("null")), (None, words("alone")), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA)
    out = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()), key=repr)
    assert out == sorted([(1, words("a", 40)), (2, words("own")), (3, words("twice")), (4, words("null")), (None, words("alone")), (5, ""), (5, "")], key=repr)


def test_mix_of_rows_with_null_and_repeated_ids(spark):
    """Rows of an id that is null, or repeats with equal or other texts, come out as often as the mix takes each of them."""
    from tidewave.llm import mixing

    ids = [None] * 40 + [7] * 40 + [8] * 20 + list(range(100, 160))
    texts = [words(f"t{k}x", 5 + k % 4) if i != 8 else "same text of all" for k, i in enumerate(ids)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 4}", len(t)) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)
    out = [tuple(r) for r in corpus_pipeline.mix(spark, docs, DATA).collect()]
    asked = mixing.mix_sources(docs).collect()
    count = lambda rows: sorted((str(i), s, n) for i, s, n in rows)
    assert count((r.doc_id, r.source, r.size) for r in asked for _ in range(r.copies)) == count((i, s, len(t.split())) for i, t, _, s, _ in out)
    assert sum(x[0] is None for x in out) > 0 and {x[1] for x in out} <= set(texts) and max(out.count(x) for x in out if x[0] != 8) <= 2
    assert sorted(out, key=repr) == sorted((tuple(r) for r in corpus_pipeline.mix(spark, docs.repartition(7), DATA).collect()), key=repr)


def test_lines_keep_rows_of_any_id(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((None, "a b"), (None, "a b"), (1, "c d"), (1, "e f"), (1, "e f"))], SCHEMA)
    assert sorted(corpus_pipeline.drop_lines(spark, docs, DATA).collect(), key=repr) == sorted(docs.collect(), key=repr)


def plain_lines(rows):
    """Documents without the lines that over a hundredth, and three at least, of their source's different texts have."""
    blank = " \t\r\x0b\x0c"
    pages, count = {}, {}
    for r in rows:
        if r["source"] is not None:
            pages.setdefault(r["source"], set()).add(r["text"])
    for source, texts in pages.items():
        for text in texts:
            for line in {x.strip(blank) for x in (text or "").split("\n")} - {""}:
                count[source, line] = count.get((source, line), 0) + 1
    gone = {k for k, n in count.items() if n >= 3 and n > len(pages[k[0]]) * corpus_pipeline.SHARE}
    keep = lambda r: r["text"] if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(blank)) not in gone)
    return [r | {"text": keep(r)} for r in rows]


def plain_copies(rows):
    """Of each document how often the mix takes it."""
    sizes, total = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}, {}
    for r in rows:
        total[r["source"]] = total.get(r["source"], 0) + sizes[r["doc_id"]]
    aims, copies = brute_targets(total, (3, 1, 2), 1.5, 2.0), {}
    for source in total:
        u = int(hashlib.md5(f"7:{'true' if source is None else 'false'}:{source or ''}".encode()).hexdigest()[:7], 16) / 16**7
        ids = sorted((r["doc_id"] for r in rows if r["source"] == source), key=lambda i: (len(format(sizes[i], "b")), hashlib.md5(str(i).encode()).hexdigest(), i))
        rate = aims[source] / total[source] if total[source] else 0.0
        for k, i in enumerate(ids, 1):
            copies[i] = min(2, math.floor(k * rate + u) - math.floor((k - 1) * rate + u))
    return copies


def test_run_equals_a_plain_pipeline(spark, tmp_path):
    """Every stage on the smallest table and some rows that are null, empty, near copies or toxic, one document at a time."""
    docs = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    long = docs[0]["text"] or "a b c d e f g"
    docs += [{"doc_id": 9000 + k, "text": t, "lang": "en", "source": s, "n_chars": len(t or "")} for k, (t, s) in enumerate([(None, "new"), ("", "new"), (long + " and more", "new"), (long + " and more", None), ("one two", None)])]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    at, weights = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    weight = dict(zip(at.tolist(), weights.astype("float32").tolist()))
    toxic = lambda t: sum(weight.get(i, 0.0) for i in [*next(toxicity.by_text(pa.array([t], pa.string()))).tolist(), 1 << toxicity.BITS]) >= 0
    rows = plain_lines([r for r in docs if not toxic(r["text"])])
    found = brute_components([r["doc_id"] for r in rows], [r["text"] for r in rows], 5, 80)
    rows = [r for r in rows if found[r["doc_id"]][1] == r["doc_id"]]
    copies, plain = plain_copies(rows), Tokenizer.from_file(packing.default_tokenizer())
    expected = []
    for r in rows:
        ids, start = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1], 0
        for n in packing.lengths(len(ids), 2048):
            expected += [(r["doc_id"], start, n, tuple(ids[start : start + n]))] * copies[r["doc_id"]]
            start += n
    assert sorted((r.doc_id, r.start, r.length, tuple(r.ids)) for r in got) == sorted(expected)
    assert len({r.sequence_id for r in got}) == len(got)


def test_stages_of_empty_tables_and_odd_columns(spark, tmp_path):
    """No rows give none; columns of the names that the stages use inside come through."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = "score double, predicted string, line string, _row long, copies long, size long, component_id long"
    docs = spark.createDataFrame([(k, f"text of {k} and so on to the end", "en", None if k == 2 else "s", 0, 0.5, "p", "l", 7, 7, 7, 7) for k in range(4)] + [(None, None, None, None, None, None, None, None, None, None, None, None)], f"{SCHEMA}, {more}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {r.line for r in out.filter("doc_id is not null").collect()} == {"l"}, name
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_very_long_text_goes_through(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = ["long " * 100_000 + "end", "line\n" * 50_000, " ".join(f"w{k}" for k in range(60_000)), " ".join(f"w{k}" for k in range(60_100))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    out = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2]
