"""Streams give the batch operators' rows."""

import pytest
from pyspark.sql import functions as F

from tidewave.operators import drift, filters, ordered
from tidewave.sources.recordings import event_samples
from tidewave.streaming import causal


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream"))
    s = event_samples(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).select("subject", "idx", "h").cache()
    for k in range(3):
        s.filter(F.floor(F.col("idx") / 25) == k if k < 2 else F.col("idx") >= 50).coalesce(1).write.mode("append").parquet(path)
    return s, path


def run(spark, path, schema, make, name):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def rows(df):
    """Sorted by keys and positions, which are whole numbers and come first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [x for x in r if isinstance(x, int)])


def same(got, expected):
    """Equal, numbers to a relative 1e-9: a stream sums in another order."""
    got, expected = rows(got), rows(expected)
    assert len(got) == len(expected) > 0
    assert all(x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip(got, expected))


def test_low_pass(spark, batches):
    s, path = batches
    got = run(spark, path, s.schema, lambda x: causal.low_pass(x, "subject", "idx", "h", 0.25), "filtered")
    same(got, filters.causal_low_pass(s, ["subject"], "idx", ["h"], 0.25))


def test_robust_baseline(spark, batches):
    s, path = batches
    got = run(spark, path, s.schema, lambda x: causal.robust_baseline(x, "subject", "idx", "h", 4, 6), "based")
    same(got, drift.robust_baseline(s, ["subject"], "idx", "h", 4, 6, 3.0))


def test_runs(spark, batches):
    s, path = batches
    got = run(spark, path, s.schema, lambda x: causal.threshold_runs(x, "subject", "idx", "h", 20.0, 2), "above")
    last = s.groupBy("subject").agg(F.max("idx").alias("last"))
    ended = ordered.mask_runs(s, ["subject"], "idx", F.col("h") > 20, 2).join(last, "subject").filter(F.col("end") <= F.col("last")).drop("last")
    same(got, ended)


def test_tumbling(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("t", F.col("ts").cast("timestamp")).select("t", "event_type", "value")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    got = run(spark, str(tmp_path / "e"), e.schema, lambda x: causal.tumbling(x, "t", ["event_type"], "value", "1 day", "1 hour"), "days")
    assert got.agg(F.sum("n")).first()[0] > 900
    sessions = run(spark, str(tmp_path / "e"), e.schema, lambda x: causal.session_counts(x, "t", ["event_type"], "1 hour", "1 hour"), "sessions")
    assert sessions.count() > 10
