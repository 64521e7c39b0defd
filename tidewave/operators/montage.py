"""Projections of recorded channels to a horizontal and a vertical one, and checks of their signs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

#: Substrings that name an electrode's side, in order of preference, and a sign per data set.
SIDES = {"right": ["REOG", "RIGHT", "_R"], "left": ["LEOG", "LEFT", "_L"], "up": ["UEOG", "UP", "_U"], "down": ["DEOG", "DOWN", "_D"]}
PAIRS = {"H": ["H", "HEOG", "EOG_H", "EOG_0"], "V": ["V", "VEOG", "EOG_V", "EOG_1"]}


def find_channel(names: list[str], patterns: list[str]) -> str | None:
    """The first name that holds a pattern; an earlier pattern outranks an earlier name."""
    return next((n for p in patterns for n in names if p.upper() in n.upper()), None)


def bipolar(df: DataFrame, flip_h: bool = False, flip_v: bool = False, channels: list[str] | None = None) -> DataFrame:
    """df with H = right - left and V = up - down, from electrodes found by name, else the first four channels in order; the originals stay."""
    names = channels or [c for c in df.columns if re.search("EOG", c, re.IGNORECASE)]
    found = {side: find_channel(names, patterns) for side, patterns in SIDES.items()}
    if None in found.values():
        if len(names) < 4:
            raise ValueError(f"no electrodes in {names}")
        found = dict(zip(("right", "left", "up", "down"), names))
    h, v = F.col(found["right"]) - F.col(found["left"]), F.col(found["up"]) - F.col(found["down"])
    return df.withColumns({"H": -h if flip_h else h, "V": -v if flip_v else v})


def passthrough(df: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """df with H and V from channels named so, else from exactly two channels in order."""
    names = channels or list(df.columns)
    out = {}
    for axis, patterns in PAIRS.items():
        out[axis] = next((n for p in patterns for n in names if n.upper() == p), None)
    if None in out.values():
        if len(names) != 2:
            raise KeyError(f"no H and V in {names}")
        out = dict(zip(("H", "V"), names))
    return df.withColumns({axis: F.col(n) for axis, n in out.items()})


def sign_check(df: DataFrame, events: DataFrame, by: list[str], order: str, x: str, expected: float = 1.0) -> DataFrame:
    """by, mean, right: whether the channel's mean within [s1_on, s1_end) has the expected sign; true where the event is unknown."""
    known = events.filter("s1_on is not null and s1_end > s1_on").select(*by, "s1_on", "s1_end")
    means = df.join(known, by).filter((F.col(order) >= F.col("s1_on")) & (F.col(order) < F.col("s1_end"))).groupBy(*by).agg(F.avg(x).alias("mean"))
    return events.select(*by).distinct().join(means, by, "left").withColumn("right", F.coalesce(F.col("mean") * expected > 0, F.lit(True)))


def pair_correlations(long: DataFrame, target: DataFrame, by: list[str], order: str, k: int = 3) -> DataFrame:
    """axis, a, b, z, rank: for all pairs of channels (a < b) the mean over recordings of the Fisher transform of the correlation of their difference with each target
    axis, the k greatest in size. long: by, order, channel, value; target: by, order, axis, value.

    Channels are few: a recording's samples are joined once for each pair of them.
    """
    a = long.select(*by, order, F.col("channel").alias("a"), F.col("value").alias("xa"))
    b = long.select(*by, order, F.col("channel").alias("b"), F.col("value").alias("xb"))
    t = target.select(*by, order, "axis", F.col("value").alias("y"))
    pairs = a.join(b, [*by, order]).filter("a < b").join(t, [*by, order])
    r = pairs.groupBy(*by, "axis", "a", "b").agg(F.corr(F.col("xa") - F.col("xb"), F.col("y")).alias("r")).filter("r is not null and not isnan(r)")
    z = r.groupBy("axis", "a", "b").agg(F.avg(F.atanh(F.greatest(F.least("r", F.lit(0.999)), F.lit(-0.999)))).alias("z"))
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("axis").orderBy(F.abs("z").desc(), "a", "b"))).filter(F.col("rank") <= k)
