"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source's documents stand in one order: by the number of binary digits of their size, then by the MD5 of doc_id. A document is
expected target / source_size times; with one random offset per source, it is emitted once for each integer that the running sum of
expected copies crosses. As like sizes are neighbours, the words taken come near the target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidewave.llm.store import written

#: A source's order is cut into runs of equal digits and equal beginning of the MD5, as long as gives so many rows a run, so that a source is never one task's.
RUN = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def _offset(source):
    """A fixed pseudo-random number in [0, 1) for each source and seed."""
    return F.conv(F.substring(F.md5(source.cast("binary")), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size): share of all words is dealt by weight, no source gets over most times its
    words, and what exceeds that is dealt again by weight. Sources are in order of code point, null last; the weights repeat."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("all", F.sum("source_size").over(everything))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    x = x.withColumn("size_before", F.sum("source_size").over(full.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("weight_on", F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = (F.col("all") * share - F.coalesce("size_before", F.lit(0)) * most) / F.col("weight_on")
    x = x.withColumn("level", F.when(F.col("source_size") * most > level * F.col("weight"), level))
    x = x.withColumn("first_level", F.max("level").over(everything))  # levels fall once a source is not filled: the greatest is the first
    return x.select("source", "source_size", F.when(F.col("level").isNull() | F.col("first_level").isNull(), F.col("source_size") * F.lit(float(most))).otherwise(F.col("first_level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, carry: str | None = None) -> DataFrame:
    """One row per document: doc_id, size (words; null text: 0), source_size, target, taken (copies * size), source, copies.

    Every document gets the whole number of copies below or above target / source_size, at most ceil(most). The same rows give
    the same copies in every run: equal (doc_id, size) within a source are interchangeable, null doc_id come first. A null
    source is a source of its own. Sources without words are never taken. Other columns are ignored; no documents give no rows.
    The column carry, if given, comes along with its row's copies, and its hash tells apart rows of equal (doc_id, size).
    """
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    code = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    extra = [carry] if carry else []
    sized = docs.select("doc_id", "source", size.alias("size"), *extra)
    if not extra:
        sized = written(sized)  # words are counted once; with what is carried along that would be written too
    prefix = max(1, math.ceil(math.log(max(1, (docs if extra else sized).count()) / RUN, 16)))
    sized = sized.withColumn("code", code).withColumn("digits", F.length(F.bin("size"))).withColumn("head", F.substring("code", 1, prefix))
    sized = sized.withColumn("null_source", F.col("source").isNull()).withColumn("key", F.coalesce("source", F.lit("")))
    run = ["null_source", "key", "digits", "head"]
    runs = sized.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    order = Window.partitionBy("null_source", "key").orderBy("digits", "head")
    before = runs.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).select(*run, "before")
    sizes = runs.groupBy("null_source", "key").agg(F.sum("words").alias("source_size")).select(F.when(~F.col("null_source"), F.col("key")).alias("source"), "source_size")
    aims = targets(sizes, weights, share, most).select(F.col("source").isNull().alias("null_source"), F.coalesce("source", F.lit("")).alias("key"), "source_size", "target")
    starts = before.join(aims, ["null_source", "key"])
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy(*run).orderBy("code", F.col("doc_id").asc_nulls_first(), "size", *map(F.xxhash64, extra))))
    x = ranked.join(starts, run)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("before") + F.col("rank")
    u = _offset(F.concat(F.lit(f"{seed}:"), F.col("null_source").cast("string"), F.lit(":"), F.col("key")))
    copies = F.least(F.floor(at * rate + u) - F.floor((at - 1) * rate + u), F.lit(int(-(-most // 1)))).cast("long")
    return x.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"), *extra)
