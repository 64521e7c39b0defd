"""Sliding windows by sample index, their labels, fixation flags and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewave.functions.columns import by_order

REST = 0


def event_class(control: Column) -> Column:
    """Class of a sample by its control signal: 1, 2 and 3 are themselves, all else (null too) is rest."""
    return F.when(control.isin(1, 2, 3), control.cast("int")).otherwise(F.lit(REST))


def event_class_from_times(idx: Column, s1_on: Column, s1_end: Column, s2_on: Column, s2_end: Column, b_on: Column, b_end: Column) -> Column:
    """Class of a sample by event positions (null: unknown), ends included; a later event hides an earlier one."""
    return F.when(idx.between(b_on, b_end), 3).when(idx.between(s2_on, s2_end), 2).when(idx.between(s1_on, s1_end), 1).otherwise(REST)


def window_starts(df: DataFrame, by: list[str], order: str, win: int, stride: int) -> DataFrame:
    """by, window_start for every full window of a recording; shorter recordings have none."""
    n = df.groupBy(*by).agg((F.max(order) + 1).alias("_n")).filter(F.col("_n") >= win)
    return n.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - win, F.lit(stride).cast("long"))).alias("window_start"))


def window_rows(df: DataFrame, by: list[str], order: str, win: int, stride: int) -> DataFrame:
    """df once for each full window that a row lies in, with window_start. Made from the row's own position, so nothing is joined but the length."""
    n = df.groupBy(*by).agg((F.max(order) + 1).alias("_n")).filter(F.col("_n") >= win)
    lowest = F.greatest(F.lit(0), F.ceil((F.col(order) - (win - 1)) / stride))
    highest = F.least(F.floor(F.col(order) / stride), F.floor((F.col("_n") - win) / stride))
    x = df.join(n, by).filter(lowest <= highest)
    x = x.withColumn("_w", F.explode(F.sequence(lowest, highest)))
    return x.withColumn("window_start", F.col("_w") * stride).drop("_n", "_w")


def window_arrays(df: DataFrame, by: list[str], order: str, columns: list[str], win: int, stride: int) -> DataFrame:
    """by, window_start and an array of each column, in order. A row goes to the windows that it lies in, and each window is gathered once."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns]
    rows = window_rows(df.filter(F.col(order) >= 0).select(*by, order, *values), by, order, win, stride)
    x = rows.groupBy(*by, "window_start").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns))).alias("_rows"))
    return x.filter(F.size("_rows") == win).select(*by, F.col("window_start").cast("long").alias("window_start"), *(F.col(f"_rows.{c}").alias(c) for c in columns))


def classification_windows(df: DataFrame, by: list[str], order: str, label: Column, win: int, stride: int, share: float = 0.5, classes: int = 4) -> DataFrame:
    """by, window_start, y_class: the commonest class (ties: the lowest), or rest where it has less than share of the window."""
    w = by_order(by, order).rowsBetween(-(win - 1), 0)
    counts = {f"_c{k}": F.sum((label == k).cast("int")).over(w) for k in range(classes)}
    x = df.withColumns(counts | {"_n": F.count(F.lit(1)).over(w)}).filter((F.col("_n") == win) & ((F.col(order) - (win - 1)) % stride == 0))
    best = F.greatest(*(F.col(c) for c in counts))
    first = F.coalesce(*(F.when(F.col(f"_c{k}") == best, F.lit(k)) for k in range(classes)))
    return x.select(*by, (F.col(order) - (win - 1)).alias("window_start"), F.when(best >= share * win, first).otherwise(F.lit(REST)).alias("y_class"))


def regression_windows(df: DataFrame, by: list[str], order: str, targets: dict[str, str], win: int, stride: int) -> DataFrame:
    """by, window_start and the means of the target columns over each window, under the names given."""
    w = by_order(by, order).rowsBetween(-(win - 1), 0)
    x = df.withColumns({f"_{k}": F.avg(c).over(w) for k, c in targets.items()} | {"_n": F.count(F.lit(1)).over(w)})
    x = x.filter((F.col("_n") == win) & ((F.col(order) - (win - 1)) % stride == 0))
    return x.select(*by, (F.col(order) - (win - 1)).alias("window_start"), *(F.col(f"_{k}").alias(k) for k in targets))


def fixation_flags(df: DataFrame, by: list[str], order: str, control: str, win: int, stride: int, settle: int) -> DataFrame:
    """by, window_start, is_fixation: the window lies in one stretch of control 1 or 2 and begins at least settle samples after its start."""
    w = by_order(by, order)
    x = df.withColumn("_new", (~F.col(control).eqNullSafe(F.lag(control).over(w))) | F.lag(order).over(w).isNull())
    x = x.withColumn("_a", F.last(F.when(F.col("_new"), F.col(order)), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_end_a", F.lead("_a", win - 1).over(w)).filter((F.col(order) % stride == 0) & F.col("_end_a").isNotNull())
    held = F.col(control).isin(1, 2) & (F.col("_a") == F.col("_end_a")) & (F.col(order) - F.col("_a") >= settle)
    return x.select(*by, F.col(order).alias("window_start"), F.coalesce(held, F.lit(False)).alias("is_fixation"))


def step_target(idx: Column, s1_end: Column, s2_on: Column, angle: Column) -> Column:
    """0, then the angle from the end of the first saccade, then 0 from the onset of the second."""
    return F.when(idx >= s2_on, 0.0).when(idx >= s1_end, angle).otherwise(0.0)


def expand_cues(df: DataFrame, cues: DataFrame, by: list[str], order: str, control: str, columns: list[str]) -> DataFrame:
    """df with the columns of its cue: cues (by, cue, ..) are numbered from 0, and each onset of control 1 or 2 begins the next.

    A cue holds until the next one, samples before the first have the first. A recording with another number of cues than onsets raises.
    """
    w = by_order(by, order)
    onset = F.col(control).isin(1, 2) & ~F.coalesce(F.col(control) == F.lag(control).over(w), F.lit(False))
    x = df.withColumn("_cue", F.sum(F.coalesce(onset, F.lit(False)).cast("int")).over(w))
    counts = x.groupBy(*by).agg(F.max("_cue").alias("_onsets")).join(cues.groupBy(*by).agg(F.count(F.lit(1)).alias("_cues")), by, "left")
    right = F.coalesce(F.col("_onsets") == F.col("_cues"), F.lit(False))
    checked = counts.select(*by, F.when(right, True).otherwise(F.raise_error(F.lit("cues do not match onsets"))).alias("_right"))
    x = x.withColumn("cue", F.greatest(F.col("_cue") - 1, F.lit(0))).join(checked, by).filter("_right")
    return x.join(cues.select(*by, "cue", *columns), [*by, "cue"], "left").drop("_cue", "cue", "_right")


def trial_parts(df: DataFrame, by: list[str], order: str, control: str) -> DataFrame:
    """df with trial: how many stretches of control 1 have begun (0: the lead-in)."""
    w = by_order(by, order)
    onset = F.coalesce((F.col(control) == 1) & (F.lag(control, 1, -1).over(w) != 1), F.lit(False))
    return df.withColumn("_on", onset.cast("int")).withColumn("trial", F.sum("_on").over(w)).drop("_on")


def splice(df: DataFrame, kept: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows of df (with trial) of the lead-in and of kept trials (by, trial), numbered anew from 0."""
    lead = df.filter("trial = 0")
    x = lead.unionByName(df.filter("trial > 0").join(kept.select(*by, "trial").distinct(), [*by, "trial"], "left_semi"))
    return x.withColumn("_at", F.row_number().over(by_order(by, order)) - 1).drop(order).withColumnRenamed("_at", order)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """label, n, percent."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("_all"))).select(label, "n", (F.col("n") * 100.0 / F.col("_all")).alias("percent"))
