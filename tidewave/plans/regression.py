"""Feature tables for gaze regression, and nested selection over them: compositions of the operators, under one configuration."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidewave.config import Config, Preprocessing
from tidewave.functions.columns import stride_samples, window_samples
from tidewave.functions.tables import settled
from tidewave.operators import drift, features, filters, folds, metrics, normalise, windows

HEAD = ("yaw", "pitch", "roll")


def _n(x: float) -> str:
    """A number as a part of a column's name: no points."""
    return f"{float(x):g}".replace(".", "p")


def _causal(cfg: Preprocessing) -> bool:
    return cfg.median_baseline_causal if cfg.drift_removal_method == "moving_median" else cfg.baseline_causal


def without_drift(df: DataFrame, by: list[str], order: str, channels: list[str], fs: float, cfg: Preprocessing = Preprocessing()) -> DataFrame:
    """df's keys, positions and channels without drift, each channel computed once: a baseline reads its input several times, so the next one's would compute it as often."""
    x = df.select(*by, order, *channels)
    for c in channels:
        x = settled(drift.remove_baseline(x, by, order, c, c, fs, cfg))
    return x


def preprocessed(df: DataFrame, events: DataFrame, by: list[str], subject: list[str], order: str, channels: list[str], fs: float, cfg: Config = Config(), rest_ms: float = 200.0, flat: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(df's keys, positions and channels without drift, low-passed, a mains spike notched, by each subject's rest; the rest's statistics). flat: without_drift of df, if it is there."""
    x = flat if flat is not None else without_drift(df, by, order, channels, fs, cfg.preprocessing)
    x = filters.clean(x, by, order, channels, fs, cfg.preprocessing.notch_hz)
    stats = normalise.rest_stats(x, events, by, subject, order, channels, max(1, int(round(rest_ms * fs / 1000.0))))
    return normalise.zscore(x, stats, subject, channels), stats


def context_names(channels: list[str], cfg: Preprocessing = Preprocessing()) -> list[str]:
    """Columns that context() adds, in order."""
    names = [f"{c}_{method}_{_n(sec)}s" for method, sec in cfg.context_baselines for c in channels] + [f"{c}_lag_{_n(lag)}s" for lag in cfg.context_lags_sec for c in channels]
    names += [f"{c}_{kind}_{_n(low)}_{_n(high)}_{_n(sec)}s" for sec in cfg.context_range_windows_sec for low, high in cfg.context_range_quantiles for c in channels for kind in ("level", "range", "ratio")]
    return names + [f"{axis}_{kind}" for axis in HEAD for kind in ("mean", "relative")] * bool(cfg.context_head_pose)


def context(raw: DataFrame, clean: DataFrame, stats: DataFrame, starts: DataFrame, by: list[str], subject: list[str], order: str, channels: list[str], fs: float, cfg: Preprocessing = Preprocessing(), flat: DataFrame | None = None) -> DataFrame:
    """starts (by, window_start) with what the configuration asks for: how other baselines of the raw channels differ from the main one, by the rest's
    deviation; levels of earlier windows; rolling ranges; head pose (columns yaw, pitch, roll of raw). flat: without_drift of raw, if it is there."""
    win, step, causal, out = window_samples(fs), max(1, int(fs // 8)), _causal(cfg), starts
    for c in channels if cfg.context_baselines else ():
        x = raw.select(*by, order, c)
        main = drift.remove_baseline(x, by, order, c, c, fs, cfg) if flat is None else flat
        sd = raw.select(*dict.fromkeys([*by, *subject])).distinct().join(stats.select(*subject, f"{c}_sd"), subject, "left")
        for method, sec in cfg.context_baselines:
            other = drift.remove_baseline(x, by, order, c, c, fs, cfg, method, float(sec), causal)
            out = features.baseline_features(x, main, other, out, by, order, c, win, sd, f"{c}_{method}_{_n(sec)}s")
    for lag in cfg.context_lags_sec:
        then = F.greatest(F.col("window_start") - int(round(float(lag) * fs)), F.lit(0))
        means = features.window_means(clean, by, order, channels, starts.select(*by, then.alias("window_start")).distinct(), win)
        means = means.select(*by, F.col("window_start").alias("_then"), *(F.col(c).alias(f"{c}_lag_{_n(lag)}s") for c in channels))
        out = out.withColumn("_then", then).join(means, [*by, "_then"], "left").drop("_then")
    least = int(round(10.0 * fs / step))
    for sec in cfg.context_range_windows_sec:
        for low, high in cfg.context_range_quantiles:
            for c in channels:
                out = features.range_features(clean, out, by, order, c, win, step, max(2, int(round(float(sec) * fs / step))), least, low, high, not causal)
                out = out.withColumnsRenamed({f"{c}_{kind}": f"{c}_{kind}_{_n(low)}_{_n(high)}_{_n(sec)}s" for kind in ("level", "range", "ratio")})
    if cfg.context_head_pose:
        out = features.head_features(raw, out, by, order, list(HEAD), win, max(2, int(round(cfg.baseline_window_sec * fs))), not causal)
    return out


def feature_matrix(df: DataFrame, events: DataFrame, by: list[str], subject: list[str], order: str, channels: list[str], fs: float, cfg: Config = Config(), engineered: bool = True) -> DataFrame:
    """by, window_start, y_h, y_v, is_fixation, the windows' own features (if engineered) and their context: the table that a regression is fitted to. df has
    the channels, target_h, target_v and control, and yaw, pitch, roll where the configuration asks for head pose."""
    win, stride, df = window_samples(fs), stride_samples(fs), settled(df)
    flat = without_drift(df, by, order, channels, fs, cfg.preprocessing)
    clean, stats = preprocessed(df, events, by, subject, order, channels, fs, cfg, flat=flat)
    clean, stats = settled(clean), settled(stats)
    y = windows.regression_windows(df, by, order, {"y_h": "target_h", "y_v": "target_v"}, win, stride)
    settle = max(1, int(round(cfg.segmentation.fixation_settle_ms * fs / 1000.0)))
    y = y.join(windows.fixation_flags(df, by, order, "control", win, stride, settle), [*by, "window_start"], "left")
    if engineered:
        y = y.join(features.window_features(windows.window_arrays(clean, by, order, channels, win, stride), channels, fs), [*by, "window_start"])
    y = settled(y)
    starts = y.select(*by, "window_start")
    if names := context_names(channels, cfg.preprocessing):
        y = y.join(context(df, clean, stats, starts, by, subject, order, channels, fs, cfg.preprocessing, flat).select(*by, "window_start", *names), [*by, "window_start"])
    return y


def evaluate(predictions: DataFrame, subject: list[str], by: list[str] | None = None) -> DataFrame:
    """by, score_fixation (mean of the axes' fixation errors, by subject first) and score_rmse (mean of the axes' root mean squares), of rows with finite predictions."""
    by = by or []
    x = predictions.filter(metrics.finite("yhat_h", "yhat_v"))
    each = x.groupBy(*by, *subject).agg(*(f for a in "hv" for f in (F.avg(F.when(F.col("is_fixation"), F.abs(F.col(f"yhat_{a}") - F.col(f"y_{a}")))).alias(f"_mae_{a}"), F.sum(F.pow(F.col(f"yhat_{a}") - F.col(f"y_{a}"), 2)).alias(f"_sq_{a}"))), F.count(F.lit(1)).alias("_n"))
    root = lambda a: F.sqrt(F.sum(f"_sq_{a}") / F.sum("_n"))
    out = each.groupBy(*by) if by else each
    return out.agg(((F.avg("_mae_h") + F.avg("_mae_v")) / 2).alias("score_fixation"), ((root("h") + root("v")) / 2).alias("score_rmse"))


def nested(matrix: DataFrame, subject: list[str], candidates: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], outer: int = 5, inner: int = 4, criterion: str = "score_fixation") -> tuple[DataFrame, DataFrame]:
    """(predictions, chosen): each row of matrix predicted by the candidate that did best on inner folds of its outer fold's training subjects, refitted to
    all of them; and outer, candidate, score of the choices.

    A candidate maps (training rows, rows) to rows with yhat_h and yhat_v. The loops are over folds and candidates only; what they fit and predict is distributed.
    """
    deal = lambda x, k: settled(folds.group_folds(x, subject, k))
    matrix = settled(matrix)
    outside = deal(matrix, outer).withColumnRenamed("fold", "outer")
    x = matrix.join(F.broadcast(outside), subject) if _few(outside) else matrix.join(outside, subject)
    scores, numbers = [], [r[0] for r in outside.select("outer").distinct().orderBy("outer").collect()]
    for k in numbers:
        train = x.filter(F.col("outer") != k)
        inside = train.join(deal(train, inner).withColumnRenamed("fold", "inner"), subject)
        held = [r[0] for r in inside.select("inner").distinct().orderBy("inner").collect()]
        for ordinal, (name, predict) in enumerate(candidates.items()):
            guesses = reduce(DataFrame.unionByName, (predict(inside.filter(F.col("inner") != j), inside.filter(F.col("inner") == j)).select(*subject, "y_h", "y_v", "yhat_h", "yhat_v", "is_fixation") for j in held))
            scores.append(evaluate(guesses, subject).select(F.lit(k).alias("outer"), F.lit(0).alias("inner"), F.lit(ordinal).alias("ordinal"), F.lit(name).alias("candidate"), F.col(criterion).alias("score")))
    chosen = folds.select_nested(reduce(DataFrame.unionByName, scores))
    best = {r["outer"]: r["candidate"] for r in chosen.collect()}  # a row for each outer fold
    out = reduce(DataFrame.unionByName, (candidates[best[k]](x.filter(F.col("outer") != k), x.filter(F.col("outer") == k)).withColumn("candidate", F.lit(best[k])) for k in numbers))
    return out, chosen


def _few(table: DataFrame, rows: int = 200_000) -> bool:
    """Whether a table is small enough to broadcast."""
    return table.limit(rows + 1).count() <= rows


def anchored_scores(predictions: DataFrame, by: list[str], subject: list[str], fs: float, seconds: tuple[float, ...] = (30.0, 60.0, 120.0)) -> DataFrame:
    """seconds, estimate (anchored or plain), score_fixation, score_rmse: with a known gaze every so often, and the plain predictions of the same windows."""
    out = []
    for sec in seconds:
        x = metrics.anchored(predictions, by, int(round(sec * fs))).filter("anchored_h is not null")
        for name, prefix in (("anchored", "anchored"), ("plain", "yhat")):
            y = x.withColumns({f"yhat_{a}": F.col(f"{prefix}_{a}") for a in "hv"})
            out.append(evaluate(y, subject).select(F.lit(float(sec)).alias("seconds"), F.lit(name).alias("estimate"), "score_fixation", "score_rmse"))
    return reduce(DataFrame.unionByName, out)


def trial_cues(df: DataFrame, by: list[str], order: str, control: str = "control") -> DataFrame:
    """by, trial, p1_h, p1_v, p2_h, p2_v: the targets at each trial's first sample and at its first one of control 2 (none: the first again)."""
    x = windows.trial_parts(df, by, order, control).filter("trial > 0")
    at = lambda a, only: F.min_by(F.when(only, F.col(f"target_{a}")), F.when(only, F.col(order)))
    found = x.groupBy(*by, "trial").agg(*(f for a in "hv" for f in (at(a, F.lit(True)).alias(f"p1_{a}"), at(a, F.col(control) == 2).alias(f"_p2_{a}"))))
    return found.select(*by, "trial", "p1_h", "p1_v", *(F.coalesce(f"_p2_{a}", f"p1_{a}").alias(f"p2_{a}") for a in "hv"))


def kept_trials(cues: DataFrame, by: list[str], scenario: str, seed: int = 0, n: int | None = None) -> DataFrame:
    """by, trial of the cues that a scenario keeps: full; right or top (both targets are); centre (both within two thirds of the largest target of each
    axis); random (n by hash); block (n that follow each other, from a place by hash)."""
    if scenario == "full":
        return cues.select(*by, "trial")
    if scenario in ("right", "top"):
        a = "h" if scenario == "right" else "v"
        return cues.filter((F.col(f"p1_{a}") > 0) & (F.col(f"p2_{a}") > 0)).select(*by, "trial")
    if scenario == "centre":
        limit = cues.groupBy(*by).agg(*((F.max(F.greatest(F.abs(F.col(f"p1_{a}")), F.abs(F.col(f"p2_{a}")))) * 2 / 3).alias(f"_{a}") for a in "hv"))
        inside = reduce(lambda x, y: x & y, (F.abs(F.col(f"{p}_{a}")) <= F.col(f"_{a}") for p in ("p1", "p2") for a in "hv"))
        return cues.join(limit, by).filter(inside).select(*by, "trial")
    if scenario in ("random", "block") and n is not None:
        from pyspark.sql import Window

        order = F.xxhash64(*by, "trial", F.lit(seed)) if scenario == "random" else F.col("trial")
        x = cues.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order, "trial"))).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        first = F.lit(0) if scenario == "random" else F.pmod(F.xxhash64(*by, F.lit(seed)), F.greatest(F.col("_m") - n + 1, F.lit(1)))
        return x.filter((F.col("_k") > first) & (F.col("_k") <= first + n)).select(*by, "trial")
    raise ValueError(f"unknown scenario {scenario}")


def head_corrected(df: DataFrame, by: list[str], correct: bool = True) -> DataFrame:
    """df with its targets less the head's angles about their means over the recording (yaw from target_h, pitch from target_v); null angles change nothing."""
    if not correct:
        return df
    means = df.groupBy(*by).agg(F.avg("yaw").alias("_yaw"), F.avg("pitch").alias("_pitch"))
    less = lambda target, angle: F.col(target) - F.coalesce(F.col(angle) - F.col(f"_{angle}"), F.lit(0.0))
    return df.join(means, by).withColumns({"target_h": less("target_h", "yaw"), "target_v": less("target_v", "pitch")}).select(*df.columns)
