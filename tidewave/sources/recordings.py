"""Recordings as long tables of samples: readers, a normaliser of wide tables by column name, adapters, checks, sinks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed patterns that tell columns apart by name, tried in this order; what none matches is left out.
KINDS = [("fs", r"(?i)^(fs|srate|sampling)"), ("angle", r"(?i)(angle|target|gaze|_ga)"), ("pose", r"(?i)(pose|head)"), ("event", r"(?i)(event|timestamp|trigger)"), ("control", r"(?i)^control"), ("eog", r"(?i)(eog|electrode|^h$|^v$|ch\d*)")]
#: Fixed pattern of a folder that holds one subject, and patterns of a sampling rate in a description, in order.
SUBJECT = r"(?i)^(sub|s\d+|subject)"
RATES = [r"(?i)sampling\s+(?:rate|frequency)\D{0,20}?(\d+(?:\.\d+)?)\s*hz", r"(?i)sampled\s+at\s+(\d+(?:\.\d+)?)\s*hz", r"(?i)fs\s*=\s*(\d+(?:\.\d+)?)", r"(?i)(\d+(?:\.\d+)?)\s*hz"]
EVENTS = ["s1_on", "s1_end", "s2_on", "s2_end", "b_on", "b_end"]


def column_kinds(columns: list[str]) -> dict[str, str]:
    """name -> fs, angle, pose, event, control or eog."""
    found = {}
    for c in columns:
        kind = next((k for k, p in KINDS if re.search(p, c)), None)
        if kind:
            found[c] = kind
    return found


def sampling_rate(description: str, fallback: float = 256.0) -> float:
    """The first rate that a description names, else the fallback."""
    for p in RATES:
        if m := re.search(p, description):
            return float(m[1])
    return fallback


def read_csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Samples of CSV files under path with their subject from the folder or file name. A file that can't be read raises; a line that does not fit the schema
    has nulls, and stands in _corrupt_record where the schema has that column (see unreadable)."""
    x = spark.read.schema(schema).options(header=True, recursiveFileLookup=True, **options).csv(path)
    return with_subject(x)


def unreadable(df: DataFrame, by: list[str]) -> DataFrame:
    """by, reason, n: how many lines of each recording of read_csv (with _corrupt_record in its schema) did not fit."""
    return df.filter("_corrupt_record is not null").groupBy(*by).agg(F.lit("lines not readable").alias("reason"), F.count(F.lit(1)).alias("n"))


def with_rates(df: DataFrame, rates: dict[str, float], fallback: float, dataset: str = "dataset_source") -> DataFrame:
    """df with fs: its own where it is positive, else its data set's by name, else the fallback."""
    table = F.create_map(*(F.lit(x) for pair in rates.items() for x in pair)) if rates else None
    own = F.when(F.col("fs") > 0, F.col("fs").cast("double")) if "fs" in df.columns else F.lit(None).cast("double")
    named = table[F.col(dataset)] if rates else F.lit(None).cast("double")
    return df.withColumn("fs", F.coalesce(own, named, F.lit(float(fallback))))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return with_subject(spark.read.schema(schema).option("recursiveFileLookup", True).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_subject(df: DataFrame) -> DataFrame:
    """df with subject_id: the last folder or file name of its path that looks like a subject, in upper case."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = F.filter(parts, lambda p: p.rlike(SUBJECT))
    return df.withColumn("subject_id", F.upper(F.regexp_replace(F.coalesce(F.element_at(named, -1), F.element_at(parts, -1)), r"\.[A-Za-z0-9]+$", "")))


def long_channels(df: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """keys, channel, value from wide columns."""
    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in channels)).unpivot(keys, channels, "channel", "value")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Data sets by name, missing columns null. None: an error."""
    if not frames:
        raise ValueError("no data sets")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def known_events(df: DataFrame) -> DataFrame:
    """df with -1 in the event columns as null."""
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in EVENTS})


def invalid(df: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """by, reason: recordings without samples, with a rate that isn't positive, or whose known events go back in time."""
    known = F.filter(F.array(*EVENTS), lambda x: x.isNotNull())
    back = events.filter(F.array_sort(known) != known).select(*by, F.lit("events not in order").alias("reason"))
    rate = df.groupBy(*by).agg(F.min("fs").alias("fs")).filter("fs is null or fs <= 0").select(*by, F.lit("rate not positive").alias("reason"))
    none = events.select(*by).distinct().join(df.select(*by).distinct(), by, "left_anti").select(*by, F.lit("no samples").alias("reason"))
    return back.union(rate).union(none)


def event_samples(events: DataFrame, fs: float = 256.0) -> DataFrame:
    """subject, idx, control, h, v, target_h, target_v, fs: an event table (event_id, ts, user_id, event_type, value, props) as recordings, one per user. Positions are
    counted by the column that the samples keep, so that what is done by recording next finds them dealt already."""
    from pyspark.sql import Window

    w = Window.partitionBy("subject").orderBy("ts", "event_id")
    control = F.create_map(*(F.lit(x) for pair in (("view", 1), ("purchase", 2), ("signup", 3)) for x in pair))
    x = events.withColumnRenamed("user_id", "subject").select("subject", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.coalesce(control[F.col("event_type")], F.lit(0)).alias("control"), F.col("value").alias("h"), F.get_json_object("props", "$.k").cast("double").alias("v"), "event_id")
    return x.withColumns({"target_h": F.col("v") - 50.0, "target_v": F.col("v") % 20.0 - 10.0, "fs": F.lit(fs)})


def line_samples(lines: DataFrame, fs: float = 256.0) -> DataFrame:
    """subject, idx, h, v of an order-line table: long recordings, one per supplier; dealt as those of event_samples are."""
    from pyspark.sql import Window

    w = Window.partitionBy("subject").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return lines.withColumnRenamed("l_suppkey", "subject").select("subject", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("l_quantity").cast("double").alias("h"), F.col("l_extendedprice").cast("double").alias("v"), F.lit(fs).alias("fs"))


def save(df: DataFrame, path: str, form: str = "parquet", partition: list[str] | None = None) -> None:
    """A table as Parquet, JSON, CSV or ORC; one that is there is replaced."""
    out = df.write.mode("overwrite")
    out = out.partitionBy(*partition) if partition else out
    out.option("header", True).format(form).save(path)
