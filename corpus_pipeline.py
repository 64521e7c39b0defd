"""A pipeline over documents: STAGES in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewave.llm import line_dedup, mixing, near_dup, packing, toxicity
from tidewave.llm.store import keyed_join, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A source holds many sites, so one site's boilerplate is a small share of it: what over one in a hundred of a source's different texts share, and
#: three at least (the operator's floor), is not written by their authors.
SHARE = 0.01


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of these documents, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select("text", F.struct("*").alias("_doc")), model).filter("predicted = 0").select("_doc.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that over SHARE of their source's different texts have. Copies count once, since a later stage keeps one of
    them whole. Documents without any line left keep an empty text."""
    kept = line_dedup.drop_boilerplate(docs.select("source", "text", F.struct("*").alias("_doc")), "source", "text", ratio=SHARE, distinct=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*(new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, Jaccard similarity of 0.8 or more. It is the one of the smallest id; a null id comes
    last, and of rows that repeat an id, the smallest hash of all columns comes first. Documents without words all stay.

    Rows are told apart by a number of their own, so ids may be null or repeat.
    """
    rows = written(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")))  # written, so that the numbers stay
    groups = written(near_dup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), words=5, threshold=0.8).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")))
    first = F.struct(F.col("_doc.doc_id").isNull(), F.col("_doc.doc_id"), F.xxhash64("_doc"), "_row").alias("_first")
    kept = groups.join(rows.select("_row", first), "_row").groupBy("_group").agg(F.min("_first").alias("_first")).select("_first._row")
    gone = written(groups.join(kept, "_row", "left_anti").select("_row"))
    return keyed_join(rows, gone, ["_row"], "left_anti").select("_doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a document taken twice is two rows. Each row has its own copies, whatever its id."""
    taken = mixing.mix_sources(docs.withColumn("_doc", F.struct(*docs.columns)), carry="_doc").filter("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids whose lengths are powers of two up to 2048, each from one document."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("minhash", drop_near_duplicates), ("mixing", mix), ("packing", pack)]
#: Models, minwise values and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
