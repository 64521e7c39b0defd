"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewave.llm import bpe, embed_dup, kd_means, language, line_dedup, merkle, mixing, near_dup, packing, quality, quotes, sql, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    return line_dedup.dedup_pages(_table(spark, sf_dir, "pages"))


def op2_quality(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quotes(spark, sf_dir):
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def op4_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), keep_ids=False)


def op5_minhash(spark, sf_dir):
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op6_embedding(spark, sf_dir):
    return embed_dup.embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.sign_codes(F.col("embedding")).alias("code"))
    found = topk.top_k(rows, rows.filter("id % 20 = 0"), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op11_merkle(spark, sf_dir):
    """Every document proven against the manifest, a fifth of them with changed texts."""
    docs = _table(spark, sf_dir, "documents")
    row = lambda text: merkle.row_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = docs.select("doc_id", "source", row(F.col("text")).alias("leaf"), F.when(tampered, row(lower)).alias("shown"))
    proven = merkle.manifest(leaves, "leaf", "source", "doc_id").withColumn("folded_root", merkle.folded(F.coalesce("shown", "leaf"), F.col("path")))
    return proven.select("doc_id", "leaf", "subroot", "root", merkle.path_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_bpe(spark, sf_dir):
    decoded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.id_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroids(spark, sf_dir):
    assigned, centroids = kd_means.cluster(_table(spark, sf_dir, "embeddings"))
    of = centroids.select("cluster", "cluster_inertia", "inertia", kd_means.digest(F.col("centroid")).alias("centroid_sha256"))
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_quotes, op4_packing, op5_minhash, op6_embedding, op7_mixing, op8_language, op9_toxicity, op10_topk, op11_merkle, op12_bpe, op13_centroids)}
SQL = {"op1_line_dedup": sql.OP1, "op3_quotes": sql.OP3, "op5_minhash": sql.OP5, "op6_embedding": sql.OP6, "op7_mixing": sql.OP7, "op10_topk": sql.OP10, "op11_merkle": sql.OP11, "op13_centroids": sql.OP13}
