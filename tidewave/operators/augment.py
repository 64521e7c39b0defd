"""Augmentation of window arrays as column expressions, each draw fixed by keys and a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def uniform(*keys: Column, seed: int) -> Column:
    """In (0, 1], the same for the same keys and seed."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)


def normal(*keys: Column, seed: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(*keys, seed=seed))) * F.cos(2 * math.pi * uniform(*keys, seed=seed + 7919))


def rolled(x: Column, shift: Column) -> Column:
    """x turned so that its last `shift` values come first (negative: the first ones last)."""
    k = F.pmod(shift, F.size(x)).cast("int")
    return F.when(k == 0, x).otherwise(F.concat(F.slice(x, F.size(x) - k + 1, k), F.slice(x, F.lit(1), F.size(x) - k)))


def augmented(df: DataFrame, keys: list[str], channels: list[str], seed: int, scale: tuple[float, float] = (0.9, 1.1), noise: float = 0.02, shift: int = 2, dropout: float = 0.0) -> DataFrame:
    """df with each channel's array scaled, with noise, and all channels rolled by one random shift; with dropout, one random channel may be zero."""
    k = [F.col(c) for c in keys]
    move = F.floor(uniform(*k, F.lit("shift"), seed=seed) * (2 * shift + 1) - 1e-9) - shift
    lost = F.when(uniform(*k, F.lit("drop"), seed=seed) <= dropout, F.floor(uniform(*k, F.lit("which"), seed=seed) * len(channels) - 1e-9)).otherwise(-1)
    def channel(j: int, c: str) -> Column:
        by = scale[0] + (scale[1] - scale[0]) * uniform(*k, F.lit(c), seed=seed)
        drawn = F.transform(c, lambda x, i: x * by + noise * normal(*k, F.lit(c), i, seed=seed))
        return F.transform(rolled(drawn, move), lambda x: F.when(lost == j, 0.0).otherwise(x))

    out = {c: channel(j, c) for j, c in enumerate(channels)}
    return df.withColumns(out)


def mixup(df: DataFrame, batch: list[str], keys: list[str], arrays: list[str], numbers: list[str], alpha: float, seed: int) -> DataFrame:
    """df mixed with the next row of its batch in a random order: arrays and numbers are lam * own + (1 - lam) * other, lam >= 0.5 by batch.

    lam is from Beta(alpha, alpha) by Johnk's method with a fixed number of draws; the label of the other row is in other_keys.
    """
    w = Window.partitionBy(*batch).orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = [F.col(c) for c in batch]
    tries = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(F.pow(uniform(*b, i, F.lit("a"), seed=seed), F.lit(1 / alpha)).alias("x"), F.pow(uniform(*b, i, F.lit("b"), seed=seed), F.lit(1 / alpha)).alias("y")))
    good = F.element_at(F.filter(tries, lambda t: (t.x + t.y <= 1) & (t.x + t.y > 0)), 1)
    lam = F.coalesce(good["x"] / (good["x"] + good["y"]), F.lit(0.5))
    x = df.withColumn("_lam", F.greatest(lam, 1 - lam))
    other = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in [*arrays, *numbers, *keys]}
    x = x.withColumns({f"_{c}": v for c, v in other.items()})
    mixed = {c: F.zip_with(c, f"_{c}", lambda p, q: F.col("_lam") * p + (1 - F.col("_lam")) * q) for c in arrays} | {c: F.col("_lam") * F.col(c) + (1 - F.col("_lam")) * F.col(f"_{c}") for c in numbers}
    return x.withColumns(mixed).select(*df.columns, F.col("_lam").alias("lam"), *(F.col(f"_{c}").alias(f"other_{c}") for c in keys))
