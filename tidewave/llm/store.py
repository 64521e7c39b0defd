"""Shared folders for intermediate tables, and joins whose broadcasts are bounded."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a table of ids that may be broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 200_000


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode a temporary one where none is set. A cluster must have one, which all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewave-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and has known size."""
    path = f"{folder(df.sparkSession)}/tidewave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more; other tables, and None, are left alone."""
    for table in tables:
        if path := getattr(table, "_written_at", None):
            session = table.sparkSession
            where = session._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)


def counted(df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
    """df written, and the number of its rows (where a condition holds), counted in what was written. Not by an Observation: a session that has made
    one can't send MLlib's models that keep a summary to tasks."""
    table = written(df)
    return table, (table if where is None else table.filter(where)).count()


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts are long: no more than so many rows go to Python, or are decoded from Parquet, at once, in this session."""
    for key, default in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.parquet.columnarReaderBatchSize", "4096")):
        if not 0 < int(spark.conf.get(key, default)) <= rows:
            spark.conf.set(key, rows)


def byte_batches(spark: SparkSession, size: int = 1 << 24) -> None:
    """Rows of an operator's own tables may be large: no more than about so many bytes go to Python at once, in this session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, f"{size + 1}b").rstrip("bB")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, size)


def keyed_join(df: DataFrame, ids: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """df joined with a written table of ids (of so many rows, where they are known), which is broadcast only if counted to be small."""
    return df.join(F.broadcast(ids) if (ids.count() if rows is None else rows) <= BROADCAST_ROWS else ids, on, how)


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text, modulo."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
