"""Drift baselines: polynomial, moving median, and robust moving mean or line, past-only or centred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tidewave.config import Preprocessing
from tidewave.operators.filters import high_pass
from tidewave.operators.ordered import block_average, decimate, hold, interpolate, rolling_quantiles

MAD = 1.4826
#: A clip below this many robust standard deviations is raised to it, so that at least half of the values are kept.
LEAST_CLIP = 0.68
#: Blocks of a recording that one task finds the baselines of.
CHUNK = 4_096


def polynomial(df: DataFrame, by: list[str], order: str, x: str, name: str) -> DataFrame:
    """df with x less its least-squares parabola over the recording. Sums are taken about the middle position, so two passes."""
    middle = df.groupBy(*by).agg(F.avg(order).alias("_m"), F.max(F.abs(F.col(order))).cast("double").alias("_s"))
    y = df.join(middle, by).withColumn("_t", (F.col(order) - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1.0)))
    t = F.col("_t")
    sums = y.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(F.pow(t, k)).alias(f"t{k}") for k in (1, 2, 3, 4)), *(F.sum(F.pow(t, k) * F.col(x)).alias(f"x{k}") for k in (0, 1, 2)))
    # the three normal equations by Cramer's rule
    det = lambda a, b, c, d, e, f, g, h, i: f"({a})*(({e})*({i})-({f})*({h}))-({b})*(({d})*({i})-({f})*({g}))+({c})*(({d})*({h})-({e})*({g}))"
    whole = det("n", "t1", "t2", "t1", "t2", "t3", "t2", "t3", "t4")
    fit = sums.select(*by, *(F.expr(f"({top})/({whole})").alias(name_) for name_, top in (
        ("_p0", det("x0", "t1", "t2", "x1", "t2", "t3", "x2", "t3", "t4")), ("_p1", det("n", "x0", "t2", "t1", "x1", "t3", "t2", "x2", "t4")), ("_p2", det("n", "t1", "x0", "t1", "t2", "x1", "t2", "t3", "x2")))))
    return y.join(fit, by).withColumn(name, F.col(x) - (F.col("_p0") + F.col("_p1") * t + F.col("_p2") * t * t)).drop("_m", "_s", "_t", "_p0", "_p1", "_p2")


def moving_median(df: DataFrame, by: list[str], order: str, x: str, name: str, step: int, n: int, centre: bool = False) -> DataFrame:
    """df with x less the median of the last n of every step-th sample, held until the next; centred: of the n about it (the upper one of an even
    number, the end ones repeated), with lines between."""
    kept = decimate(df.select(*by, order, x), order, step).withColumn("block", F.floor(F.col(order) / step))
    if centre:
        base = windowed(kept, by, x, n // 2, n - n // 2 - 1, lambda v: np.partition(np.lib.stride_tricks.sliding_window_view(v, n), n // 2, axis=1)[:, n // 2], "_median")
        return interpolate(df, base, by, order, "_median", step, "_base", at=0.0).withColumn(name, F.col(x) - F.col("_base")).drop("_base")
    base = rolling_quantiles(kept, by, "block", x, n, {"_base": 0.5})
    return hold(df, base, by, order, ["_base"], step).withColumn(name, F.col(x) - F.col("_base")).drop("_base")


def _baselines(values: np.ndarray, n: int, clip: float, line: bool) -> np.ndarray:
    """Of each window of n values, the mean of those within clip robust deviations of its median; or the value that the least-squares line through them
    has one place after the window."""
    windows = np.lib.stride_tricks.sliding_window_view(values, n)
    off = windows - np.median(windows, axis=1, keepdims=True)
    kept = np.abs(off) <= max(clip, LEAST_CLIP) * MAD * np.median(np.abs(off), axis=1, keepdims=True)
    if not line:
        return np.where(kept, windows, 0.0).sum(axis=1) / kept.sum(axis=1)
    ahead = np.arange(-n, 0.0)  # places, seen from the one after the window
    count, off = kept.sum(axis=1), np.where(kept, off, 0.0)
    s, ss = kept @ ahead, kept @ (ahead * ahead)
    y, sy = off.sum(axis=1), off @ ahead
    spread = count * ss - s * s
    slope = np.where(spread > 0, (count * sy - s * y) / np.where(spread > 0, spread, 1.0), 0.0)
    return np.median(windows, axis=1) + (y - slope * s) / count


def windowed(blocks: DataFrame, by: list[str], x: str, back: int, ahead: int, kernel: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """by, block, name: the kernel's value of each window from back blocks before to ahead after, of blocks (by, block, x) whose numbers have no gaps; the
    end ones are repeated beyond the ends. A recording is cut into runs of CHUNK blocks, each with those that its windows reach, so that a
    long one is many tasks'."""
    ends = blocks.groupBy(*by).agg(F.min_by(x, "block").cast("double").alias("_first"), F.max_by(x, "block").cast("double").alias("_last"), F.max("block").alias("_end"))
    run = lambda at: F.floor(at / CHUNK)
    spread = blocks.select(*by, "block", F.col(x).cast("double").alias("_x")).join(ends, by).withColumn("_run", F.explode(F.sequence(run(F.greatest(F.col("block") - ahead, F.lit(0))), run(F.least(F.col("block") + back, F.col("_end"))))))
    schema = StructType([f for f in spread.schema if f.name in by]).add("block", "long").add(name, "double")
    keys = [*by, "_run"]

    def value(at: np.ndarray, values: np.ndarray, first: float, last: float, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a run's own blocks, and what the kernel makes of their windows."""
        own = np.flatnonzero(at // CHUNK == number)
        low, high = int(own[0]), int(own[-1])
        before, after = max(0, back - low), max(0, ahead - (len(at) - 1 - high))
        padded = np.concatenate([np.full(before, first), values, np.full(after, last)])
        return own, kernel(padded[before + low - back : before + high + ahead + 1])

    def each(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        at, values, first, last, number = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("block", "_x", "_first", "_last", "_run"))
        found = [(a + own, made) for a, z in zip(starts, [*starts[1:], len(rows)]) for own, made in [value(at[a:z], values[a:z], first[a], last[a], number[a])]]
        kept = rows.select([*by, "block"]).take(pa.array(np.concatenate([own for own, _ in found])))
        return kept.append_column(name, pa.array(np.concatenate([made for _, made in found]), pa.float64())).combine_chunks().to_batches()[0]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs come one after the other; the last one of a batch waits for the next."""
        rest = None
        for batch in (b for b in batches if len(b)):
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            new = np.zeros(len(rows) - 1, bool)
            for c in keys:
                column = rows.column(c)
                new |= pc.not_equal(column.slice(1), column.slice(0, len(rows) - 1)).to_numpy()
            starts = np.append(0, np.flatnonzero(new) + 1)
            if len(starts) > 1:
                yield each(rows.slice(0, starts[-1]), starts[:-1])
            rest = rows.slice(starts[-1])
        if rest is not None:
            yield each(rest, np.zeros(1, int))

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks are few bytes for the work that they are
    dealt = spread.select(*by, F.col("block").cast("long").alias("block"), "_x", "_first", "_last", "_run").repartition(tasks, *keys).sortWithinPartitions(*keys, "block")
    return dealt.mapInArrow(runs, schema)


def robust_baseline(df: DataFrame, by: list[str], order: str, x: str, step: int, n: int, clip: float = 1.0, centre: bool = False, line: bool = False) -> DataFrame:
    """by, block, base: robust mean of n block means up to each block (the first one repeated before the start), or about it (the end ones repeated);
    with line, a robust line through those up to each block, at the next block."""
    if centre and line:
        raise ValueError("a line is past-only")
    back, ahead = (n // 2, (n - 1) // 2) if centre else (n - 1, 0)
    return windowed(block_average(df, by, order, [x], step), by, x, back, ahead, lambda v: _baselines(v, n, clip, line), "base")


def robust_mean(df: DataFrame, by: list[str], order: str, x: str, name: str, step: int, n: int, clip: float = 1.0, centre: bool = False, line: bool = False) -> DataFrame:
    """df with x less its robust baseline. Past-only: a block's baseline corrects the next block, and the first block is less its first sample.
    Centred: the line between block centres. Recordings of fewer than two blocks are less their mean."""
    base = robust_baseline(df, by, order, x, step, n, clip, centre, line)
    counts = df.groupBy(*by).agg((F.floor((F.max(order) + 1) / step)).alias("_blocks"), F.avg(x).alias("_mean"), F.min_by(x, order).alias("_zero"))
    y = df.join(counts, by)
    if centre:
        out = interpolate(y, base, by, order, "base", step, "_base")
    else:
        out = hold(y, base, by, order, ["base"], step, delay=1).withColumn("_base", F.when(F.col(order) < step, F.col("_zero")).otherwise(F.col("base"))).drop("base")
    short = y.filter("_blocks < 2").withColumn("_base", F.col("_mean"))
    out = short.select(*df.columns, "_base").unionByName(out.filter("_blocks >= 2").select(*df.columns, "_base"))
    return out.withColumn(name, F.col(x) - F.col("_base")).drop("_base")


def robust_line(df: DataFrame, by: list[str], order: str, x: str, name: str, step: int, n: int, clip: float = 1.0) -> DataFrame:
    """df with x less the robust line through the n block means before each block, at that block: without the mean's lag of half a window."""
    return robust_mean(df, by, order, x, name, step, n, clip, line=True)


def remove_baseline(df: DataFrame, by: list[str], order: str, x: str, name: str, fs: float, cfg: Preprocessing = Preprocessing(), method: str | None = None, seconds: float | None = None, causal: bool | None = None) -> DataFrame:
    """df with x less its drift, by the method that cfg or the argument names: highpass, polynomial_detrend (a parabola), moving_median, robust_mean or
    robust_line (past-only where causal; a line is fitted only then). Windows are in seconds, blocks are of an eighth of a second."""
    method, step = method or cfg.drift_removal_method, max(1, int(fs // 8))
    median = method == "moving_median"
    seconds = seconds if seconds is not None else cfg.median_baseline_sec if median else cfg.baseline_window_sec
    causal = causal if causal is not None else cfg.median_baseline_causal if median else cfg.baseline_causal
    n = int(round(seconds * fs / step))
    if method == "highpass":
        y = high_pass(df.select(*by, order, F.col(x).alias(name)), by, order, [name], fs, cfg.highpass_cutoff_hz, cfg.filter_order)
        return df.select(*(c for c in df.columns if c != name)).join(y, [*by, order])
    if method == "polynomial_detrend":
        if cfg.polynomial_detrend_order != 2:
            raise ValueError("the polynomial is a parabola")
        return polynomial(df, by, order, x, name)
    if median:
        return moving_median(df, by, order, x, name, step, max(1, n), centre=not causal)
    if method in ("robust_mean", "robust_line"):
        return robust_mean(df, by, order, x, name, step, max(2, n), cfg.baseline_clip_mad, centre=not causal, line=causal and method == "robust_line")
    raise ValueError(f"unknown method {method}")
