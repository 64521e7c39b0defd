"""Subject-grouped folds, validation subjects, exact caps, nested selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewave.functions.tables import settled


def _turns(load: list[int], size: int, count: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How count subjects of a size are dealt to the lightest folds (ties: the first one): (from, folds) stretches in which they take turns, and the loads after it.

    A fold gets a subject at each level from load // size on, and those of one level come in order of what is left over, so the turns are the same until the next fold is
    reached."""
    level, order = [x // size for x in load], sorted(range(len(load)), key=lambda f: (load[f] % size, f))
    at, turns, load = 0, [], list(load)
    steps = sorted(set(level))
    for now, then in zip(steps, [*steps[1:], None]):
        folds = [f for f in order if level[f] <= now]
        if at >= count:
            break
        turns.append((at, folds))
        dealt = count - at if then is None else min(count - at, (then - now) * len(folds))
        for i, f in enumerate(folds):
            load[f] += size * (dealt // len(folds) + (i < dealt % len(folds)))
        at += dealt
    return turns, load


def group_folds(df: DataFrame, subject: list[str], k: int = 5, strategy: str = "group") -> DataFrame:
    """subject, fold: each subject is in one fold. Largest first into the lightest fold (ties: by subject, then the first fold); as many folds as
    subjects (leave one out) where there are fewer than k, or if asked for.

    The greedy deal runs over the different sizes, subjects of equal size in bulk, so what comes to the driver is no more than the square root of twice the rows. Subjects are
    numbered within their size by one sort by ranges.
    """
    if strategy not in ("group", "leave_one_out"):
        raise ValueError(f"unknown strategy {strategy}")
    counts = df.groupBy(*subject).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), *subject]
    x = settled(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    ranges = x.groupBy("n", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_k"))
    along = Window.partitionBy("n").orderBy("_range")
    ranges = ranges.select("n", "_range", (F.sum("_k").over(along) - F.col("_k") - F.col("_first")).alias("_shift"))
    before, load, rows, sizes = 0, [0] * k, [], x.groupBy("n").count().orderBy(F.col("n").desc()).collect()
    alone = strategy == "leave_one_out" or sum(r["count"] for r in sizes) < k
    for r in sizes:
        turns, load = ([], load) if alone else _turns(load, r.n, r["count"])
        rows.append((r.n, before, turns))
        before += r["count"]
    dealt = df.sparkSession.createDataFrame(rows, "n long, _before long, _turns array<struct<since:long,folds:array<int>>>")
    x = x.join(ranges, ["n", "_range"]).join(dealt, "n").withColumn("_place", F.col("_at") + F.col("_shift"))
    turn = F.element_at(F.filter("_turns", lambda t: t["since"] <= F.col("_place")), -1)
    x = x.withColumn("_turn", turn) if not alone else x
    fold = (F.col("_before") + F.col("_place")).cast("int") if alone else F.col("_turn.folds")[((F.col("_place") - F.col("_turn.since")) % F.size("_turn.folds")).cast("int")]
    return x.select(*subject, fold.alias("fold"))


def leakage(df: DataFrame, folds: DataFrame, subject: list[str]) -> DataFrame:
    """Subjects in more than one fold, or in none: none should be."""
    return df.select(*subject).distinct().join(folds, subject, "left").groupBy(*subject).agg(F.count_distinct("fold").alias("folds")).filter("folds <> 1")


def validation_subjects(df: DataFrame, subject: list[str], seed: int, share: float = 0.1) -> DataFrame:
    """max(1, round(share of subjects)), the same for the same seed."""
    every = df.select(*subject).distinct().withColumn("_r", F.xxhash64(*subject, F.lit(seed)))
    n = F.count(F.lit(1)).over(Window.partitionBy())  # subjects: one row each
    k = F.row_number().over(Window.orderBy("_r", *subject))
    return every.withColumns({"_n": n, "_k": k}).filter(F.col("_k") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share))).select(*subject)


def capped(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows at most, in an order fixed by keys and seed."""
    return df.withColumn("_r", F.xxhash64(*keys, F.lit(seed))).orderBy("_r", *keys).limit(n).drop("_r")


def select_nested(scores: DataFrame) -> DataFrame:
    """outer, candidate, score: the candidate of the least mean score over the inner folds (ties: the first by ordinal) of
    scores (outer, inner, ordinal, candidate, score)."""
    means = scores.groupBy("outer", "ordinal", "candidate").agg(F.avg("score").alias("score"))
    return means.groupBy("outer").agg(F.min_by(F.struct("candidate", "score"), F.struct("score", "ordinal")).alias("_b")).select("outer", "_b.candidate", "_b.score")


def nested_grid(folds: DataFrame, inner: int, candidates: DataFrame) -> DataFrame:
    """outer, inner, ordinal, candidate: every fit that nested selection needs."""
    outer = folds.select(F.col("fold").alias("outer")).distinct()
    return outer.crossJoin(folds.sparkSession.range(inner).select(F.col("id").cast("int").alias("inner"))).crossJoin(candidates)
