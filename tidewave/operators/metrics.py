"""Metrics of predictions, in grouped aggregates: regression, classification, two-level fixation errors, directions, calibration, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewave.functions.columns import direction_bin
from tidewave.operators.ordered import asof


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c)
    return out


def axis_errors(true: str, guess: str) -> list[Column]:
    """rmse, mae and r2 (null where the truth does not vary) of one axis."""
    e, y = F.col(guess) - F.col(true), F.col(true)
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(total > 0, 1 - F.sum(e * e) / total).alias("r2")]


def regression(df: DataFrame, by: list[str] | None = None, pooled: bool = False) -> DataFrame:
    """Errors of (y_h, y_v) against (yhat_h, yhat_v): rmse_h, mae_h, r2_h, the same of v, and rmse of both; rows without finite values are left out.

    With pooled, a row for each group and one (with nulls for by) for all, from one pass of grouping sets.
    """
    x = df.filter(finite("y_h", "y_v", "yhat_h", "yhat_v"))
    aggregates = [a.alias(f"{n}_{axis}") for axis in "hv" for n, a in zip(("rmse", "mae", "r2"), axis_errors(f"y_{axis}", f"yhat_{axis}"))]
    squares = F.pow(F.col("yhat_h") - F.col("y_h"), 2) + F.pow(F.col("yhat_v") - F.col("y_v"), 2)
    aggregates += [F.sqrt(F.avg(squares) / 2).alias("rmse"), F.count(F.lit(1)).alias("n")]
    if pooled:
        return x.groupingSets([[F.col(c) for c in by], []], *(F.col(c) for c in by)).agg(*aggregates)
    return x.groupBy(*(by or [])).agg(*aggregates)


def fixation(df: DataFrame, subject: list[str]) -> DataFrame:
    """mae_h, mae_v, sd_h, sd_v, subjects: errors of fixation windows by subject first, then the mean and population deviation over subjects."""
    each = df.filter(F.col("is_fixation") & finite("y_h", "y_v", "yhat_h", "yhat_v")).groupBy(*subject).agg(*(F.avg(F.abs(F.col(f"yhat_{a}") - F.col(f"y_{a}"))).alias(a) for a in "hv"))
    return each.agg(*(F.avg(a).alias(f"mae_{a}") for a in "hv"), *(F.stddev_pop(a).alias(f"sd_{a}") for a in "hv"), F.count(F.lit(1)).alias("subjects"))


def confusion(df: DataFrame, true: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("y"), F.col(guess).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def f1_scores(df: DataFrame, true: str, guess: str) -> DataFrame:
    """y, precision, recall, f1, support of each class; a ratio without cases is 0."""
    cells = confusion(df, true, guess)
    t = cells.groupBy("y").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).alias("hit"))
    p = cells.groupBy(F.col("yhat").alias("y")).agg(F.sum("n").alias("guessed"))
    x = t.join(p, "y", "full").na.fill(0, ["support", "hit", "guessed"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("hit"), F.col("guessed")), ratio(F.col("hit"), F.col("support"))
    return x.select("y", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("hit"), F.col("guessed") + F.col("support")).alias("f1"), "support")


def classification(df: DataFrame, true: str, guess: str) -> DataFrame:
    """f1_weighted, f1_macro, accuracy, n."""
    s = f1_scores(df, true, guess)
    return s.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.sum("support").alias("n"))


def majority(df: DataFrame, label: str) -> DataFrame:
    """df with yhat: the commonest label (ties: the lowest)."""
    best = df.groupBy(label).count().agg(F.max_by(label, F.struct("count", -F.col(label))).alias("yhat"))
    return df.crossJoin(F.broadcast(best))  # one row


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """label, weight for 0 .. classes - 1: n / (classes present * count), 0 for those absent, null for all if there is one at most."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    all_rows = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("present"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    weight = F.when(F.col("present") > 1, F.coalesce(F.col("all") / (F.col("present") * F.col("n")), F.lit(0.0)))
    return every.join(counts, label, "left").crossJoin(all_rows).select(label, weight.alias("weight"))


def directions(df: DataFrame, bins: int = 8, radius: float = 3.0) -> DataFrame:
    """bin (-1: the centre), n, rmse_h, rmse_v, rmse_2d; bins without rows are there with n = 0."""
    x = df.withColumn("bin", direction_bin(F.col("y_h"), F.col("y_v"), bins, radius))
    eh, ev = F.col("yhat_h") - F.col("y_h"), F.col("yhat_v") - F.col("y_v")
    found = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(eh * eh)).alias("rmse_h"), F.sqrt(F.avg(ev * ev)).alias("rmse_v"), F.sqrt(F.avg(eh * eh + ev * ev)).alias("rmse_2d"))
    every = df.sparkSession.range(-1, bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").na.fill(0, ["n"])


def reduction(df: DataFrame, raw: str, corrected: str, guess: str) -> DataFrame:
    """rmse_raw, rmse_corrected, percent by which the second is less."""
    e = lambda y: F.sqrt(F.avg(F.pow(F.col(guess) - F.col(y), 2)))
    return df.agg(e(raw).alias("rmse_raw"), e(corrected).alias("rmse_corrected")).withColumn("percent", (F.col("rmse_raw") - F.col("rmse_corrected")) / (F.col("rmse_raw") + 1e-9) * 100)


def calibration(df: DataFrame, by: list[str], alpha: float = 1e-4) -> DataFrame:
    """by, and gain and offset of each axis from truth and prediction: covariance over variance + alpha, within 0.2 and 5; gain 1 where the truth or
    the prediction hardly varies."""
    out = []
    for a in "hv":
        y, p = F.col(f"y_{a}"), F.col(f"yhat_{a}")
        gain = F.greatest(F.least(F.covar_pop(p, y) / (F.var_pop(p) + alpha), F.lit(5.0)), F.lit(0.2))
        gain = F.when((F.var_pop(y) < 5) | (F.var_pop(p) < 1e-4), 1.0).otherwise(gain)
        out += [gain.alias(f"gain_{a}"), F.avg(y).alias(f"_y_{a}"), F.avg(p).alias(f"_p_{a}")]
    x = df.groupBy(*by).agg(*out)
    return x.select(*by, *(c for a in "hv" for c in (F.col(f"gain_{a}"), (F.col(f"_y_{a}") - F.col(f"gain_{a}") * F.col(f"_p_{a}")).alias(f"offset_{a}"))))


def calibrated(df: DataFrame, by: list[str], fs: float, prompt: float = 5.0, least: int = 15) -> DataFrame:
    """Rows after each subject's prompt, with cal_h and cal_v: the first windows in time fit the calibration, the rest are scored.

    n_cal = min(max(least, ceil(prompt / max(stride in seconds, 0.05))), n // 4), the stride being that of the first two windows (0.15 s if
    it isn't positive); subjects of fewer than twenty windows are left out.
    """
    w = Window.partitionBy(*by).orderBy("window_start")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = df.filter(finite("y_h", "y_v", "yhat_h", "yhat_v")).withColumns({"_k": F.row_number().over(w), "_n": F.count(F.lit(1)).over(every), "_first": F.first("window_start").over(every), "_second": F.nth_value("window_start", 2).over(every)})
    gap = (F.col("_second") - F.col("_first")) / fs
    stride = F.greatest(F.when(gap > 0, gap).otherwise(0.15), F.lit(0.05))
    n_cal = F.least(F.greatest(F.lit(least).cast("long"), F.ceil(prompt / stride)), F.floor(F.col("_n") / 4))
    x = x.filter("_n >= 20").withColumn("_cal", F.col("_k") <= n_cal)
    fit = calibration(x.filter("_cal"), by)
    y = x.filter("not _cal").join(fit, by)
    return y.withColumns({f"cal_{a}": F.col(f"yhat_{a}") * F.col(f"gain_{a}") + F.col(f"offset_{a}") for a in "hv"}).select(*df.columns, "cal_h", "cal_v")


def anchored(df: DataFrame, by: list[str], interval: int) -> DataFrame:
    """df with anchored_h, anchored_v: in every interval of positions the truth of the first fixation window at or after its start is given, and later
    estimates add to it how the prediction has changed. Anchors themselves and rows before the first are null."""
    fixed = df.filter("is_fixation").select(*by, F.col("window_start"), F.col("window_start").alias("_at"))
    span = df.groupBy(*by).agg(F.min("window_start").alias("_low"), F.max("window_start").alias("_high"))
    grid = span.select(*by, F.explode(F.sequence("_low", "_high", F.lit(interval).cast("long"))).alias("window_start"))
    chosen = asof(grid, fixed, by, "window_start", ["_at"], forward=True, clamp=True).filter("_at is not null").select(*by, F.col("_at").alias("window_start")).distinct()
    marks = chosen.join(df.select(*by, "window_start", "y_h", "y_v", "yhat_h", "yhat_v"), [*by, "window_start"])
    renamed = marks.select(*by, "window_start", *(F.col(c).alias(f"_{c}") for c in ("y_h", "y_v", "yhat_h", "yhat_v")), F.col("window_start").alias("_at"))
    x = asof(df, renamed, by, "window_start", ["_at", "_y_h", "_y_v", "_yhat_h", "_yhat_v"])
    return x.withColumns({f"anchored_{a}": F.when(F.col("_at") < F.col("window_start"), F.col(f"_y_{a}") + F.col(f"yhat_{a}") - F.col(f"_yhat_{a}")) for a in "hv"}).drop("_at", "_y_h", "_y_v", "_yhat_h", "_yhat_v")


def paired(model: DataFrame, reference: DataFrame, subject: list[str], value: str) -> DataFrame:
    """subject, model, reference, improvement, and the signed rank of the improvement (ties share their mean rank; 0 has none). Every subject of
    the model must be in the reference."""
    x = model.select(*subject, F.col(value).alias("model")).join(reference.select(*subject, F.col(value).alias("reference"), F.lit(True).alias("_there")), subject, "left")
    x = x.withColumn("improvement", F.when(F.col("_there").isNull(), F.raise_error(F.lit("no reference"))).otherwise(F.col("reference") - F.col("model"))).drop("_there")
    nonzero = F.when(F.col("improvement") != 0, F.abs("improvement"))
    w = Window.partitionBy(nonzero.isNull()).orderBy(nonzero)  # subjects are few: one row each
    ties = F.count(F.lit(1)).over(Window.partitionBy(nonzero))
    return x.withColumn("signed_rank", F.when(nonzero.isNotNull(), F.signum("improvement") * (F.rank().over(w) + (ties - 1) / 2.0)))


def losses(df: DataFrame, label_weight: float = 1.0, angle_weight: float = 1.0, smoothing: float = 0.0, classes: int = 4) -> DataFrame:
    """cross_entropy, mse, huber, range_loss, static, uncertainty: multi-task losses of a table (y_class, logits array, y_h, y_v, yhat_h, yhat_v).

    range_loss = Huber + (1 - correlation) + |ratio of standard deviations - 1|, meaned over the axes; uncertainty at log-variances of 0.
    """
    top = F.array_max("logits")
    log_sum = top + F.log(F.aggregate(F.transform("logits", lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))
    at = F.element_at("logits", F.col("y_class") + 1)
    mean_logit = F.aggregate("logits", F.lit(0.0), lambda s, x: s + x) / classes
    ce = F.avg(log_sum - (1 - smoothing) * at - smoothing * mean_logit)
    parts = {"cross_entropy": ce}
    error = {a: F.col(f"yhat_{a}") - F.col(f"y_{a}") for a in "hv"}
    huber = lambda e: F.when(F.abs(e) <= 1, 0.5 * e * e).otherwise(F.abs(e) - 0.5)
    parts["mse"] = (F.avg(error["h"] * error["h"]) + F.avg(error["v"] * error["v"])) / 2
    parts["huber"] = (F.avg(huber(error["h"])) + F.avg(huber(error["v"]))) / 2
    shape = sum((1 - F.corr(f"yhat_{a}", f"y_{a}") + F.abs(F.stddev_pop(f"yhat_{a}") / F.stddev_pop(f"y_{a}") - 1) for a in "hv"), F.lit(0.0)) / 2
    x = df.agg(*(c.alias(k) for k, c in parts.items()), shape.alias("_shape"))
    return x.select("cross_entropy", "mse", "huber", (F.col("huber") + F.col("_shape")).alias("range_loss"), (label_weight * F.col("cross_entropy") + angle_weight * F.col("mse")).alias("static"), (F.col("cross_entropy") + F.col("mse")).alias("uncertainty"))
