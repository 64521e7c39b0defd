"""Column functions of the time-series operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def half_even(x: Column) -> Column:
    """Rounds to a whole number, halves to the even one."""
    return F.bround(x, 0).cast("long")


def ms_to_samples(ms: Column | float, fs: Column, least: int = 1) -> Column:
    """Milliseconds as a number of samples, halves to even, at least `least`."""
    return F.greatest(F.lit(least).cast("long"), half_even(F.lit(ms) * fs / 1000.0 if not isinstance(ms, Column) else ms * fs / 1000.0))


def window_samples(fs: float, ms: float = 300.0) -> int:
    """Samples of a window of ms, halves to even: 77 at 256 Hz."""
    return int(round(ms * fs / 1000.0))


def stride_samples(fs: float, ms: float = 150.0) -> int:
    return int(round(ms * fs / 1000.0))


def by_order(by: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def past(by: list[str], order: str, n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return by_order(by, order).rowsBetween(-(n - 1), 0)


def centred(by: list[str], order: str, n: int) -> WindowSpec:
    """n rows about the current one; an even n has one more before than after."""
    return by_order(by, order).rowsBetween(-(n // 2), (n - 1) // 2)


def difference(x: Column, w: WindowSpec) -> Column:
    """x less the x before; 0 for the first."""
    return F.coalesce(x - F.lag(x).over(w), F.lit(0.0))


def gradient(x: Column, w: WindowSpec) -> Column:
    """Central differences, one-sided at the ends, 0 for a single row."""
    after, before = F.lead(x).over(w), F.lag(x).over(w)
    return F.coalesce((after - before) / 2, after - x, x - before, F.lit(0.0))


def direction_bin(h: Column, v: Column, bins: int = 8, radius: float = 3.0) -> Column:
    """0 .. bins - 1 by angle from the right, counter-clockwise; -1 within the radius."""
    angle = F.pmod(F.degrees(F.atan2(v, h)), F.lit(360.0))
    return F.when(F.hypot(h, v) < radius, F.lit(-1)).otherwise(F.least(F.floor(angle / (360.0 / bins)), F.lit(bins - 1)).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def line_slope(a: Column) -> Column:
    """Least-squares slope of an array against 0 .. n - 1; 0 for fewer than two values."""
    n = F.size(a).cast("double")
    middle = (n - 1) / 2
    above = F.aggregate(F.transform(a, lambda x, i: (i - middle) * x), F.lit(0.0), lambda s, x: s + x)
    return F.when(n < 2, F.lit(0.0)).otherwise(above / (n * (n * n - 1) / 12))
