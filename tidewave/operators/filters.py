"""Filters and mains detection over recordings of any length: prefix scans over chunks, and sums over Welch segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tidewave.functions.signal import butterworth, notch, spectrum
from tidewave.functions.tables import byte_batches, settled
from tidewave.operators import scan
from tidewave.operators.ordered import placed

#: Seconds of a Welch segment of the mains detection.
SEGMENT = 4


def _zero_phase(df: DataFrame, by: list[str], order: str, channels: list[str], fs: float, hz: float, coefficients: Callable[[], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    if hz >= fs / 2:
        return df.select(*by, order, *(F.col(c).cast("double").alias(c) for c in channels))
    return scan.zero_phase(df, by, order, channels, *coefficients())


def low_pass(df: DataFrame, by: list[str], order: str, channels: list[str], fs: float, hz: float = 30.0, degree: int = 4) -> DataFrame:
    """Zero-phase Butterworth low-pass; nothing is changed from half the rate on."""
    return _zero_phase(df, by, order, channels, fs, hz, lambda: butterworth(degree, hz, fs))


def high_pass(df: DataFrame, by: list[str], order: str, channels: list[str], fs: float, hz: float = 0.2, degree: int = 4) -> DataFrame:
    """Zero-phase Butterworth high-pass, a drift baseline."""
    return _zero_phase(df, by, order, channels, fs, hz, lambda: butterworth(degree, hz, fs, True))


def notch_filter(df: DataFrame, by: list[str], order: str, channels: list[str], fs: float, hz: float = 50.0, q: float = 30.0) -> DataFrame:
    return _zero_phase(df, by, order, channels, fs, hz, lambda: notch(hz, q, fs))


def causal_low_pass(df: DataFrame, by: list[str], order: str, channels: list[str], alpha: float) -> DataFrame:
    """y += alpha * (x - y) from y = 0; what isn't finite counts as 0."""
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")).otherwise(0.0)
    return scan.recursive(df.withColumns({c: finite(c) for c in channels}), by, order, channels, [(np.array([alpha]), np.array([1.0, alpha - 1]))])


def _welch_segments(df: DataFrame, by: list[str], order: str, channels: list[str], size: int) -> DataFrame:
    """key, n (samples of the recording), items: the segments of size samples that overlap by half, or the whole of a shorter recording. A sample goes to the two segments
    that hold it."""
    step = size - size // 2
    rows = placed(df, by, order, *(F.col(c).cast("double").alias(c) for c in channels))
    last = F.greatest(F.floor((F.col("n") - size) / step), F.lit(0))
    first = F.greatest(F.floor((F.col("place") - size) / step) + 1, F.lit(0))
    held = rows.withColumn("segment", F.explode(F.sequence(first, F.floor(F.col("place") / step)))).filter(F.col("segment") <= last)
    return held.groupBy("key", "n", "segment").agg(F.sort_array(F.collect_list(F.struct("place", *channels))).alias("items"))


def mains_spike(df: DataFrame, by: list[str], order: str, channels: list[str], fs: float, hz: float = 50.0, threshold: float = 10.0) -> DataFrame:
    """by, channel, db, spike for each channel of each recording: how many dB the power density at hz is over the mean of what is 2 to 10 Hz away, and whether that
    is more than threshold. Densities are means over Welch segments of four seconds (Hann windows, each less its mean, that overlap by half), which are spread over all tasks;
    of each, two numbers are summed. No density, or a rate of no more than 2 hz, gives minus infinity."""
    byte_batches(df.sparkSession)
    size = int(SEGMENT * fs)
    segments = _welch_segments(df, by, order, channels, size)
    schema = StructType([segments.schema["key"]]).add("channel", "string").add("at", "double").add("around", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, around = [], []
            for items in batch.column("items"):
                f, p = spectrum(np.stack([np.asarray(items.values.field(c).fill_null(np.nan), float) for c in channels]), fs)
                away = np.abs(f - hz)
                near = (away > 2) & (away <= 10)
                at += p[:, away.argmin()].tolist()
                around += p[:, near].mean(axis=1).tolist() if near.any() else [0.0] * len(channels)
            of = np.repeat(np.arange(len(batch)), len(channels))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), pa.array(channels * len(batch), pa.string()), pa.array(at, pa.float64()), pa.array(around, pa.float64())], schema.names)

    if hz >= fs / 2:
        found = segments.select("key").distinct().select("key", F.explode(F.array(*map(F.lit, channels))).alias("channel"), F.lit(0.0).alias("at"), F.lit(0.0).alias("around"))
    else:
        found = segments.mapInArrow(run, schema)
    means = found.groupBy("key", "channel").agg(F.avg("at").alias("at"), F.avg("around").alias("around"))
    usable = (F.col("at") > 0) & (F.col("around") > 0) & ~F.isnan("at") & ~F.isnan("around")
    db = F.when(usable, 10 * F.log10(F.col("at") / F.col("around"))).otherwise(F.lit(float("-inf")))
    return means.select(*(F.col(f"key.`{c}`").alias(c) for c in by), "channel", db.alias("db"), (db > threshold).alias("spike"))


def clean(df: DataFrame, by: list[str], order: str, channels: list[str], fs: float, hz: float = 50.0, threshold: float = 10.0) -> DataFrame:
    """Low-pass, then a notch where the low-passed channel still has a mains spike."""
    low = low_pass(df, by, order, channels, fs)
    if hz >= fs / 2:
        return low
    low = settled(low)
    spikes = mains_spike(low, by, order, channels, fs, hz, threshold).groupBy(F.struct(*by).alias("_key")).agg(F.collect_set(F.when(F.col("spike"), F.col("channel"))).alias("_spikes"))
    spikes = settled(spikes.filter(F.size("_spikes") > 0))
    if not spikes.limit(1).count():
        return low
    cut = notch_filter(low.join(spikes, F.struct(*(low[c] for c in by)) == F.col("_key"), "left_semi"), by, order, channels, fs, hz)
    cut = cut.select(F.struct(*by).alias("_key"), F.col(order).alias("_at"), *(F.col(c).alias(f"_{c}") for c in channels))
    x = low.withColumn("_key", F.struct(*by)).join(spikes, "_key", "left").withColumn("_at", F.col(order)).join(cut, ["_key", "_at"], "left")
    return x.select(*by, order, *(F.when(F.array_contains("_spikes", c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in channels))
