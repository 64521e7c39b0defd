"""Past-only operators on streams: windowed aggregates under a watermark, and keyed state for filters, baselines and runs.

Rows of one key must come in position order within and across batches (one source partition per recording); rows at or before the last
position seen are late, and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewave.operators.drift import LEAST_CLIP, MAD


def tumbling(stream: DataFrame, ts: str, keys: list[str], value: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """keys, start, end, n, mean, low, high of each window of event time, final once the watermark has passed it."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    x = stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return x.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "low", "high")


def session_counts(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """keys, start, end, n of sessions that a pause of `gap` ends."""
    x = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return x.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _fresh(frames: Iterator[pd.DataFrame], order: str, seen: int) -> pd.DataFrame:
    x = pd.concat(list(frames)).sort_values(order)
    return x[x[order] > seen]


def low_pass(stream: DataFrame, key: str, order: str, x: str, alpha: float) -> DataFrame:
    """key, order, y: y += alpha * (x - y) from 0; what isn't finite counts as 0."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, y = state.get if state.exists else (-1, 0.0)
        rows = _fresh(frames, order, seen)
        out = []
        for v in np.nan_to_num(rows[x].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0):
            y += alpha * (v - y)
            out.append(y)
        if len(rows):
            state.update((int(rows[order].iloc[-1]), float(y)))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].to_numpy(), "y": out})

    kind = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {order} {kind[order]}, y double", "seen long, y double", "append", GroupStateTimeout.NoTimeout)


def robust_baseline(stream: DataFrame, key: str, order: str, x: str, size: int, n: int, clip: float = 3.0) -> DataFrame:
    """key, block, base: the batch operator's past-only robust mean of n block means, as each block of `size` positions is complete.

    State: the last n block means, the running block, and the position. Equal to the batch operator on the blocks that are complete.
    """

    def base(values: np.ndarray) -> float:
        middle = np.median(values)
        off = np.abs(values - middle)
        return float(values[off <= max(clip, LEAST_CLIP) * MAD * np.median(off)].mean())

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, total, count, ring = state.get if state.exists else (-1, 0.0, 0, [])
        rows, ring, out = _fresh(frames, order, seen), list(ring), []
        for at, v in zip(rows[order], rows[x].to_numpy(float)):
            total, count, seen = total + float(v), count + 1, int(at)
            if (seen + 1) % size == 0:
                if count == size:
                    mean = total / size
                    ring = (ring or [mean] * n)[1 - n :] + [mean] if n > 1 else [mean]
                    out.append((k[0], seen // size, base(np.array(ring))))
                total, count = 0.0, 0
        state.update((seen, total, count, ring))
        yield pd.DataFrame(out, columns=[key, "block", "base"])

    kind = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, block long, base double", "seen long, total double, count long, ring array<double>", "append", GroupStateTimeout.NoTimeout)


def threshold_runs(stream: DataFrame, key: str, order: str, x: str, level: float, least: int) -> DataFrame:
    """key, start, end (exclusive) of runs above the level of at least so many rows, once a row below ends them."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, start = state.get if state.exists else (-1, -1)
        rows, out = _fresh(frames, order, seen), []
        for at, v in zip(rows[order], rows[x].to_numpy(float)):
            if v > level:
                start = int(at) if start < 0 else start
            elif start >= 0:
                if at - start >= least:
                    out.append((k[0], start, int(at)))
                start = -1
            seen = int(at)
        state.update((seen, start))
        yield pd.DataFrame(out, columns=[key, "start", "end"])

    kind = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, start long, end long", "seen long, start long", "append", GroupStateTimeout.NoTimeout)
