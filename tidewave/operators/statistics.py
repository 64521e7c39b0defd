"""Paired statistics by subject: bootstrap intervals and the signed-rank test."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewave.operators.metrics import paired


def bootstrap(df: DataFrame, key: list[str], value: str, draws: int = 10_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """mean, low, high: percentile interval of the mean of df's rows (one for each subject) over resamples with replacement.

    Draw d of place k picks row pmod(hash(seed, d, k), n), so that columns resampled with one seed share their draws. The draws are spread over the cluster,
    the rows (as many as subjects) travel as one array.
    """
    values = df.agg(F.transform(F.array_sort(F.collect_list(F.struct(*key, F.col(value).alias("x")))), lambda r: r.x).alias("xs"), F.avg(value).alias("mean"))
    n = F.size("xs")
    d = df.sparkSession.range(draws).crossJoin(F.broadcast(values))  # one row
    pick = lambda k: F.element_at("xs", (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), n) + 1).cast("int"))
    means = d.withColumn("m", F.aggregate(F.transform(F.sequence(F.lit(1), n), pick), F.lit(0.0), lambda s, x: s + x) / n)
    ends = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return means.agg(F.first("mean").alias("mean"), ends.alias("e")).select("mean", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))


def signed_rank(ranks: DataFrame, rank: str = "signed_rank") -> DataFrame:
    """w, n, p: Wilcoxon's two-sided signed-rank test from signed ranks (null: no difference). Exact up to 50 ranks without ties, by counting
    the subsets of ranks with each sum; else the normal approximation with a correction for ties."""
    s = ranks.agg(F.sum(F.when(F.col(rank) > 0, F.col(rank)).otherwise(0.0)).alias("up"), F.sum(F.when(F.col(rank) < 0, -F.col(rank)).otherwise(0.0)).alias("down"), F.count(rank).alias("n"), F.count_distinct(F.abs(rank)).alias("d"))
    ties = ranks.filter(F.col(rank).isNotNull()).groupBy(F.abs(rank).alias("r")).agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).alias("tied"))
    x = s.crossJoin(F.broadcast(ties)).withColumn("w", F.least("up", "down"))  # one row each
    grow = lambda counts, r: F.transform(F.sequence(F.lit(0), F.size(counts) - 1 + r), lambda i: F.coalesce(F.get(counts, i), F.lit(0.0)) + F.coalesce(F.get(counts, i - r), F.lit(0.0)))
    counts = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.array(F.lit(1.0)), grow)
    tail = F.aggregate(F.slice(counts, 1, F.floor("w").cast("int") + 1), F.lit(0.0), lambda a, b: a + b)
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), F.col("n")))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    z = (F.col("w") - n * (n + 1) / 4) / spread
    # the normal tail by its continued expansion of erfc (Abramowitz and Stegun 7.1.26)
    t = 1 / (1 + 0.3275911 * F.abs(z) / F.sqrt(F.lit(2.0)))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    approximate = F.least(F.lit(1.0), poly * F.exp(-z * z / 2))
    p = F.when(F.col("n") == 0, 1.0).when((F.col("n") <= 50) & (F.col("d") == F.col("n")), exact).otherwise(approximate)
    return x.select("w", "n", p.alias("p"))


def compare(model: DataFrame, reference: DataFrame, subject: list[str], value: str, seed: int = 0) -> DataFrame:
    """improvement, low, high, improved, n, p of a model over a reference, paired by subject."""
    ranks = paired(model, reference, subject, value)
    interval = bootstrap(ranks, subject, "improvement", seed=seed).withColumnRenamed("mean", "improvement")
    improved = ranks.agg(F.sum((F.col("improvement") > 0).cast("int")).alias("improved"))
    return interval.crossJoin(improved).crossJoin(signed_rank(ranks)).select("improvement", "low", "high", "improved", "n", "p")
