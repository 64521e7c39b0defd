"""Per-subject normalisation from rest, and standardised context features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rest_rows(df: DataFrame, events: DataFrame, by: list[str], order: str, rest: int) -> DataFrame:
    """Rows of the `rest` samples before the first saccade's onset, else (unknown or at 0) of the first tenth, at least one."""
    n = df.groupBy(*by).agg((F.max(order) + 1).alias("_n"))
    span = n.join(events.select(*by, "s1_on"), by, "left")
    known = F.coalesce(F.col("s1_on") > 0, F.lit(False))
    low = F.when(known, F.greatest(F.col("s1_on") - rest, F.lit(0))).otherwise(F.lit(0))
    high = F.when(known, F.col("s1_on")).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))
    return df.join(span.select(*by, low.alias("_low"), high.alias("_high")), by).filter((F.col(order) >= F.col("_low")) & (F.col(order) < F.col("_high"))).drop("_low", "_high")


def rest_stats(df: DataFrame, events: DataFrame, by: list[str], subject: list[str], order: str, channels: list[str], rest: int) -> DataFrame:
    """subject, and mean and population standard deviation of each channel's pooled rest."""
    rows = rest_rows(df, events, by, order, rest)
    return rows.groupBy(*subject).agg(*(f for c in channels for f in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"))))


def zscore(df: DataFrame, stats: DataFrame, subject: list[str], channels: list[str]) -> DataFrame:
    """df with channels less their mean, by their standard deviation; 0 where that is 0, unchanged where a subject has no stats."""
    x = df.join(stats.withColumn("_known", F.lit(True)), subject, "left")
    scaled = {c: F.when(F.col("_known").isNull(), F.col(c)).when(F.col(f"{c}_sd") == 0, 0.0).otherwise((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")) for c in channels}
    return x.withColumns(scaled).select(*df.columns)


def standardise(train: DataFrame, rows: DataFrame, columns: list[str], clip: float = 10.0) -> DataFrame:
    """rows with columns standardised by train's means and population deviations (under 1e-6: 1), NaN and null to 0, clipped."""
    value = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c))
    stats = train.agg(*(f for c in columns for f in (F.avg(value(c)).alias(f"{c}_m"), F.stddev_pop(value(c)).alias(f"{c}_s"))))
    x = rows.crossJoin(F.broadcast(stats))  # one row
    z = {c: F.greatest(F.least(F.coalesce((value(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") < 1e-6, 1.0).otherwise(F.col(f"{c}_s")), F.lit(0.0)), F.lit(clip)), F.lit(-clip)) for c in columns}
    return x.withColumns(z).select(*rows.columns)
