"""Relational operators over ordered rows: runs, sessions, as-of and interval joins, rolling frames, resampling.

`by` names the columns of a recording, which is the unit of parallelism; `order` is a whole-number position that is unique within it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewave.functions.columns import by_order, centred, past

#: Positions, or rows, of a recording that are numbered or rolled over together.
CHUNK = 1 << 14


def runs(df: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """Gaps and islands: by, run (0, 1, ..), value, start, end (exclusive), n, for each longest stretch of equal values."""
    w = by_order(by, order)
    x = df.select(*by, F.col(order).alias("_o"), value.alias("value"))
    w = by_order(by, "_o")
    new = (~F.col("value").eqNullSafe(F.lag("value").over(w))) | F.lag("_o").over(w).isNull()
    x = x.withColumn("run", F.sum(new.cast("int")).over(w) - 1)
    return x.groupBy(*by, "run").agg(F.first("value").alias("value"), F.min("_o").alias("start"), (F.max("_o") + 1).alias("end"), F.count(F.lit(1)).alias("n"))


def mask_runs(df: DataFrame, by: list[str], order: str, mask: Column, least: int = 1) -> DataFrame:
    """by, start, end (exclusive) of stretches of at least `least` rows where mask holds; null does not hold."""
    return runs(df, by, order, F.coalesce(mask, F.lit(False))).filter(F.col("value") & (F.col("n") >= least)).select(*by, "start", "end")


def hysteresis(df: DataFrame, by: list[str], order: str, level: Column, enter: float, stay: float) -> DataFrame:
    """by, start, end, peak of stretches above `stay` that somewhere exceed `enter`."""
    x = df.select(*by, F.col(order).alias("_o"), level.alias("_x")).withColumn("_on", F.coalesce(F.col("_x") > stay, F.lit(False)))
    w = by_order(by, "_o")
    x = x.withColumn("_run", F.sum((F.col("_on") != F.lag("_on", 1, False).over(w)).cast("int")).over(w)).filter("_on")
    out = x.groupBy(*by, "_run").agg(F.min("_o").alias("start"), (F.max("_o") + 1).alias("end"), F.max("_x").alias("peak"))
    return out.filter(F.col("peak") > enter).drop("_run")


def merge_gaps(intervals: DataFrame, by: list[str], gap: int) -> DataFrame:
    """by, start, end, n: intervals [start, end) joined where fewer than `gap` positions lie between."""
    w = by_order(by, "start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") - reach >= gap), F.lit(True)).cast("int")
    x = intervals.withColumn("_new", new).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*by, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_group")


def sessions(df: DataFrame, by: list[str], order: str, gap: float) -> DataFrame:
    """df with session: 0, 1, .., a new one where the order has moved on by more than gap."""
    w = by_order(by, order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w)) > gap, F.lit(False)).cast("int")
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def asof(left: DataFrame, right: DataFrame, by: list[str], order: str, columns: list[str], forward: bool = False, clamp: bool = False) -> DataFrame:
    """left with the columns of the last right row at or before its position (forward: the first at or after). None: null;
    with clamp, the nearest there is on the other side.

    One sort of the two sides' union; no row is multiplied. Of right rows at one position the columns' least counts.
    """
    one = right.groupBy(*by, order).agg(F.min(F.struct(*columns)).alias("_r"))
    x = left.withColumn("_r", F.lit(None).cast(one.schema["_r"].dataType)).withColumn("_side", F.lit(1 if not forward else 0))
    y = one.select(*by, order, "_r").withColumn("_side", F.lit(0 if not forward else 1))
    both = x.unionByName(y.withColumn("_from", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(order, "_side")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    found = F.first("_r", True).over(ahead) if forward else F.last("_r", True).over(back)
    if clamp:
        found = F.coalesce(found, F.last("_r", True).over(back) if forward else F.first("_r", True).over(ahead))
    out = both.withColumn("_found", found).filter(F.col("_from").isNull())
    return out.select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in columns))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of left [start, end) and right [r_start, r_end) of one recording that overlap.

    Both sides are put into every bucket of `width` positions that they touch, so the join is an equi-join on the bucket; a pair
    counts in the first bucket that both touch. how: inner, left_semi or left_anti.
    """
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width)))
    x, y = left.withColumn("_bucket", touched("start", "end")), right.withColumn("_bucket", touched("r_start", "r_end"))
    overlap = (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    first = F.col("_bucket") == F.floor(F.greatest("start", "r_start") / width)
    if how == "inner":
        return x.join(y, [*by, "_bucket"]).filter(overlap & first).drop("_bucket")
    keys = x.join(y, [*by, "_bucket"]).filter(overlap & first).select(*by, "start", "end").distinct()
    return left.join(keys, [*by, "start", "end"], how)


def points_in(points: DataFrame, intervals: DataFrame, by: list[str], order: str, width: int) -> DataFrame:
    """points with inside: whether an interval [start, end) of the recording holds the position."""
    x = intervals.select(*by, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bucket")).filter("end > start")
    y = points.withColumn("_bucket", F.floor(F.col(order) / width))
    held = y.join(x, [*by, "_bucket"]).filter((F.col(order) >= F.col("start")) & (F.col(order) < F.col("end"))).select(*by, order).distinct().withColumn("_in", F.lit(True))
    return points.join(held, [*by, order], "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in")


def count_between(left: DataFrame, right: DataFrame, by: list[str], order: str, reach: int) -> DataFrame:
    """left with n: right rows of the recording in (position, position + reach]. Running counts at both ends, no range join."""
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ends = [left.select(*left.columns, (F.col(order) + k).alias("_at"), F.lit(1).alias("_side"), F.lit(k).alias("_end")) for k in (0, reach)]
    marks = right.select(*by, F.col(order).alias("_at"), F.lit(0).alias("_side"))
    x = ends[0].union(ends[1]).unionByName(marks, allowMissingColumns=True).withColumn("_n", F.sum((F.col("_side") == 0).cast("long")).over(w)).filter("_side = 1")
    return x.groupBy(*left.columns).agg((F.max("_n") - F.min("_n")).alias("n"))


def placed(df: DataFrame, by: list[str], order: str, *columns: Column) -> DataFrame:
    """key (the columns of by), at (the position), the columns, place (0, 1, .. by position within the recording) and n (rows of the recording). Rows are counted by chunks of CHUNK
    positions and numbered within them, so that no window holds a recording."""
    rows = df.select(F.struct(*by).alias("key"), F.col(order).alias("at"), *columns).withColumn("_chunk", F.floor(F.col("at") / CHUNK))
    counts = rows.groupBy("key", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("key").orderBy("_chunk")
    starts = counts.select("key", "_chunk", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("key")).alias("n"))
    own = rows.withColumn("_place", F.row_number().over(Window.partitionBy("key", "_chunk").orderBy("at")) - 1)
    return own.join(starts, ["key", "_chunk"]).withColumn("place", F.col("_place") + F.col("_before")).drop("_chunk", "_place", "_before")


def rolling_quantiles(df: DataFrame, by: list[str], order: str, x: str, n: int, q: dict[str, float], least: int = 1, centre: bool = False) -> DataFrame:
    """df with exact, linearly interpolated quantiles over n rows (past ones, or about the current one: an even n has one more before than after); null with fewer than least
    values. Null and not-a-number values do not count.

    A recording is cut into runs of CHUNK rows, each with those that its windows reach, and along a run a skip list of the window's values gets one value and loses one
    for each row: a row costs the logarithm of n.
    """
    back, ahead = (n // 2, (n - 1) // 2) if centre else (n - 1, 0)
    run = lambda at: F.floor(at / CHUNK)
    rows = placed(df, by, order, F.col(x).cast("double").alias("x"))
    spread = rows.withColumn("run", F.explode(F.sequence(run(F.greatest(F.col("place") - ahead, F.lit(0))), run(F.least(F.col("place") + back, F.col("n") - 1))))).drop("n")
    names = list(q)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        window = rows["x"].rolling(n, min_periods=max(1, least), center=centre)
        own = (rows["place"] // CHUNK == rows["run"]).to_numpy()
        return pd.DataFrame({"at": rows["at"], "key": rows["key"]} | {f"q{i}": window.quantile(q[name]) for i, name in enumerate(names)})[own]

    schema = StructType([spread.schema["at"], spread.schema["key"], *(StructField(f"q{i}", DoubleType()) for i in range(len(names)))])
    found = spread.groupBy("key", "run").applyInPandas(each, schema)
    out = df.withColumns({"_key": F.struct(*by), "_at": F.col(order)}).join(found.withColumnsRenamed({"key": "_key", "at": "_at"}), ["_key", "_at"])
    return out.select(*(c for c in df.columns if c not in q), *(F.when(~F.isnan(f"q{i}"), F.col(f"q{i}")).alias(name) for i, name in enumerate(names)))


def rolling_mean(df: DataFrame, by: list[str], order: str, x: str, n: int, name: str, centre: bool = False) -> DataFrame:
    return df.withColumn(name, F.avg(x).over(centred(by, order, n) if centre else past(by, order, n)))


def block_average(df: DataFrame, by: list[str], order: str, columns: list[str], step: int) -> DataFrame:
    """by, block, and means of the columns over each full block of step positions; a shorter last block is dropped."""
    x = df.groupBy(*by, F.floor(F.col(order) / step).alias("block")).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(c).alias(c) for c in columns))
    return x.filter(F.col("_n") == step).drop("_n")


def decimate(df: DataFrame, order: str, step: int) -> DataFrame:
    """Every step-th row, the first included."""
    return df.filter(F.col(order) % step == 0)


def hold(df: DataFrame, blocks: DataFrame, by: list[str], order: str, columns: list[str], step: int, delay: int = 0) -> DataFrame:
    """df with the columns of its block, held; with delay, of the block so many before. The last block goes on to the end, the first one back to the start."""
    last = blocks.groupBy(*by).agg(F.max("block").alias("_last"), F.min("block").alias("_first"))
    x = df.join(last, by).withColumn("block", F.greatest(F.least(F.floor(F.col(order) / step) - delay, F.col("_last")), F.col("_first")))
    return x.join(blocks.select(*by, "block", *columns), [*by, "block"], "left").drop("block", "_last", "_first")


def interpolate(df: DataFrame, blocks: DataFrame, by: list[str], order: str, x: str, step: int, name: str, at: float | None = None) -> DataFrame:
    """df with x of the blocks, interpolated in a line between the blocks' centres (or their places `at`, counted from their starts) and constant beyond the
    outer ones."""
    last = blocks.groupBy(*by).agg(F.max("block").alias("_last"))
    place = (F.col(order) - ((step - 1) / 2.0 if at is None else at)) / step
    y = df.join(last, by).withColumn("_p", F.least(F.greatest(place, F.lit(0.0)), F.col("_last").cast("double")))
    y = y.withColumn("_a", F.least(F.floor("_p"), F.col("_last"))).withColumn("_b", F.least(F.col("_a") + 1, F.col("_last")))
    of = lambda end, value: blocks.select(*by, F.col("block").alias(end), F.col(x).alias(value))
    y = y.join(of("_a", "_xa"), [*by, "_a"], "left").join(of("_b", "_xb"), [*by, "_b"], "left")
    return y.withColumn(name, F.col("_xa") + (F.col("_xb") - F.col("_xa")) * (F.col("_p") - F.col("_a"))).drop("_p", "_a", "_b", "_xa", "_xb", "_last")


def fill_gaps(df: DataFrame, by: list[str], order: str, x: str, name: str) -> DataFrame:
    """df with x where it is finite, and else the line between the finite neighbours (the nearest one beyond the outer ones)."""
    good = F.when(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.struct(F.col(order).alias("o"), F.col(x).alias("x")))
    w = by_order(by, order)
    y = df.withColumn("_a", F.last(good, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(good, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col(order) - F.col("_a.o")) / (F.col("_b.o") - F.col("_a.o"))
    same = F.col("_a.o") == F.col("_b.o")
    return y.withColumn(name, F.when(same, F.col("_a.x")).otherwise(F.coalesce(line, F.col("_a.x"), F.col("_b.x")))).drop("_a", "_b")


def parts(df: DataFrame, by: list[str], order: list[str], n: int = 3, name: str = "part") -> DataFrame:
    """df with its rows dealt to n contiguous parts, the first ones getting the remainder."""
    return df.withColumn(name, F.ntile(n).over(Window.partitionBy(*by).orderBy(*order)) - 1)


def first_k(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def window_means(df: DataFrame, by: list[str], order: str, columns: list[str], starts: DataFrame, win: int) -> DataFrame:
    """starts (by, window_start) with the means of the columns over [window_start, window_start + win), from a moving sum; nulls do not count."""
    means = df.select(*by, F.col(order).alias("_o"), *(F.avg(c).over(by_order(by, order).rowsBetween(-(win - 1), 0)).alias(c) for c in columns))
    return starts.withColumn("_o", F.col("window_start") + win - 1).join(means, [*by, "_o"]).drop("_o")
