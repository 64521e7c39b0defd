"""Exact expectations on small inputs, ties and edges included."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewave.config import Config, KnownStart, load, updated
from tidewave.functions.columns import stride_samples, window_samples
from tidewave.operators import drift, folds, known_start, metrics, models, montage, normalise, ordered, statistics, windows
from tidewave.sources import recordings


def table(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def series(spark, xs, **more):
    rows = [(0, i, *(v[i] for v in more.values()), float(x)) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, ["r", "i", *more, "x"])


def test_window_lengths_round_half_to_even():
    assert (window_samples(256), stride_samples(256), window_samples(250), stride_samples(250)) == (77, 38, 75, 38)


def test_runs_and_hysteresis(spark):
    s = series(spark, [0, 5, 9, 5, 0, 5, 5, 0])
    assert table(ordered.runs(s, ["r"], "i", F.col("x")).select("start", "end", "value"), "start") == [(0, 1, 0.0), (1, 2, 5.0), (2, 3, 9.0), (3, 4, 5.0), (4, 5, 0.0), (5, 7, 5.0), (7, 8, 0.0)]
    assert table(ordered.hysteresis(s, ["r"], "i", F.col("x"), 8, 4), "start") == [(0, 1, 4, 9.0)]
    gaps = spark.createDataFrame([(0, 0, 2), (0, 4, 5), (0, 9, 10)], "r int, start int, end int")
    assert table(ordered.merge_gaps(gaps, ["r"], 3), "start") == [(0, 0, 5, 2), (0, 9, 10, 1)]
    assert table(ordered.merge_gaps(gaps, ["r"], 2), "start") == [(0, 0, 2, 1), (0, 4, 5, 1), (0, 9, 10, 1)]


def test_asof_edges(spark):
    left = spark.createDataFrame([(0, t) for t in (1, 5, 9)], "r int, i long")
    right = spark.createDataFrame([(0, 5, "a"), (0, 7, "b")], "r int, i long, v string")
    assert [r[2] for r in table(ordered.asof(left, right, ["r"], "i", ["v"]), "i")] == [None, "a", "b"]
    assert [r[2] for r in table(ordered.asof(left, right, ["r"], "i", ["v"], clamp=True), "i")] == ["a", "a", "b"]
    assert [r[2] for r in table(ordered.asof(left, right, ["r"], "i", ["v"], forward=True), "i")] == ["a", "a", None]
    assert [r[2] for r in table(ordered.asof(left, right, ["r"], "i", ["v"], forward=True, clamp=True), "i")] == ["a", "a", "b"]


def test_cue_targets(spark):
    control = [1, 1, 2, 2, 3, 3, 1, 1, 2, 3, 30]
    s = series(spark, range(11), c=control)
    cues = spark.createDataFrame([(0, k, float(10 * k)) for k in range(4)], "r long, cue int, t double")
    out = windows.expand_cues(s, cues, ["r"], "i", "c", ["t"])
    assert [r[0] for r in table(out.select("t", "i"), "i")] == [0, 0, 10, 10, 10, 10, 20, 20, 30, 30, 30]
    with pytest.raises(PySparkException):
        windows.expand_cues(s, cues.filter("cue < 3"), ["r"], "i", "c", ["t"]).collect()


def test_label_ties_go_to_the_lowest_class(spark):
    s = series(spark, range(4), c=[2, 1, 1, 2])
    assert table(windows.classification_windows(s, ["r"], "i", F.col("c"), 4, 4), "r") == [(0, 0, 1)]
    s = series(spark, range(5), c=[2, 1, 1, 3, 0])
    assert table(windows.classification_windows(s, ["r"], "i", F.col("c"), 5, 5), "r") == [(0, 0, 0)]
    assert windows.window_arrays(series(spark, [1, 2]), ["r"], "i", ["x"], 3, 1).count() == 0


def test_causal_baseline_sees_no_future(spark):
    random = np.random.default_rng(1)
    x = random.normal(size=200).cumsum()
    y = x.copy()
    y[120:] += 50
    a, b = (dict(table(drift.robust_mean(series(spark, v), ["r"], "i", "x", "y", 8, 5).select("i", "y"), "i")) for v in (x, y))
    assert all(a[i] == pytest.approx(b[i]) for i in range(120)) and all(b[i] - a[i] == pytest.approx(50) for i in range(120, 128))
    assert a[199] == pytest.approx(b[199])  # the five blocks before it are all after the step
    assert a[3] == pytest.approx(x[3] - x[0])
    short = table(drift.robust_mean(series(spark, [1, 2, 3]), ["r"], "i", "x", "y", 8, 5).select("y", "i"), "i")
    assert [r[0] for r in short] == [-1, 0, 1]


def test_robust_baseline_equals_numpy(spark):
    x = np.random.default_rng(2).standard_t(2, size=400)
    blocks = x.reshape(-1, 8).mean(axis=1)
    got = [r[0] for r in table(drift.robust_baseline(series(spark, x), ["r"], "i", "x", 8, 7, 3.0).select("base", "block"), "block")]
    wide = np.concatenate([np.full(6, blocks[0]), blocks])
    for j in range(len(blocks)):
        v = wide[j : j + 7]
        off = np.abs(v - np.median(v))
        assert got[j] == pytest.approx(v[off <= 3 * 1.4826 * np.median(off)].mean())


def test_polynomial_removes_parabolas(spark):
    i = np.arange(50)
    out = drift.polynomial(series(spark, 3 + 2 * i - 0.5 * i * i), ["r"], "i", "x", "y")
    assert out.agg(F.max(F.abs("y"))).first()[0] < 1e-8


def test_zero_deviation_and_missing_stats(spark):
    s = series(spark, [1, 1, 1])
    stats = spark.createDataFrame([(0, 1.0, 0.0)], "r long, x_mean double, x_sd double")
    assert [r[2] for r in table(normalise.zscore(s, stats, ["r"], ["x"]), "i")] == [0, 0, 0]
    assert [r[2] for r in table(normalise.zscore(s, stats.filter("false"), ["r"], ["x"]), "i")] == [1, 1, 1]


def test_fixation_metrics_are_means_over_subjects(spark):
    rows = [("A", 0.0, 1.0, True), ("B", 0.0, 3.0, True), ("B", 0.0, 3.0, True), ("B", 0.0, 99.0, False), ("C", float("nan"), 1.0, True)]
    df = spark.createDataFrame(rows, "s string, y_h double, yhat_h double, is_fixation boolean").withColumns({"y_v": F.col("y_h"), "yhat_v": F.col("yhat_h")})
    assert table(metrics.fixation(df, ["s"]), "mae_h") == [(2.0, 2.0, 1.0, 1.0, 2)]


def test_calibration_recovers_gain_and_offset(spark):
    y = np.random.default_rng(3).uniform(-20, 20, size=(200, 2))
    rows = [("a", i * 37, float(h), float(v), float((h - 4) / 1.8), float((v - 4) / 1.8)) for i, (h, v) in enumerate(y)]
    df = spark.createDataFrame(rows, "s string, window_start long, y_h double, y_v double, yhat_h double, yhat_v double")
    out = metrics.calibrated(df, ["s"], 250.0)
    assert out.count() == 200 - 34 and out.agg(F.max(F.abs(F.col("cal_h") - F.col("y_h")))).first()[0] < 0.01
    flat = df.withColumn("y_h", F.lit(2.0))
    assert metrics.calibration(flat, ["s"]).first()["gain_h"] == 1.0


def test_anchors(spark):
    rows = [("a", 10 * i, float(i), 0.0, float(i + 5), 0.0, True) for i in range(40)]
    df = spark.createDataFrame(rows, "s string, window_start long, y_h double, y_v double, yhat_h double, yhat_v double, is_fixation boolean")
    out = metrics.anchored(df, ["s"], 100)
    assert [r[0] for r in table(out.filter("anchored_h is null").select("window_start"), "window_start")] == [0, 100, 200, 300]
    assert out.filter("anchored_h is not null and anchored_h <> y_h").count() == 0


def test_folds(spark):
    df = spark.createDataFrame([(f"S{k}",) for k in range(6) for _ in range(10 + k)], "s string")
    f = folds.group_folds(df, ["s"], 3)
    assert f.count() == 6 and folds.leakage(df, f, ["s"]).count() == 0 and f.select("fold").distinct().count() == 3
    assert folds.group_folds(df, ["s"], 10).select("fold").distinct().count() == 6
    with pytest.raises(ValueError):
        folds.group_folds(df, ["s"], 3, "random")
    assert folds.validation_subjects(df, ["s"], 1).count() == 1


def test_wilcoxon_exact_and_ties(spark):
    ranks = spark.createDataFrame([(float(k),) for k in range(1, 11)], "signed_rank double")
    assert statistics.signed_rank(ranks).first()["p"] == pytest.approx(2 / 1024)
    mixed = spark.createDataFrame([(float(k if k != 3 else -3),) for k in range(1, 9)], "signed_rank double")
    assert statistics.signed_rank(mixed).first()["p"] == pytest.approx(2 * 5 / 256)
    tied = spark.createDataFrame([(1.5,), (-1.5,), (3.0,)], "signed_rank double")
    assert 0 < statistics.signed_rank(tied).first()["p"] <= 1
    low, high = (statistics.bootstrap(ranks.withColumn("k", F.col("signed_rank")), ["k"], "signed_rank", 2000).first()[c] for c in ("low", "high"))
    assert 3 < low < 5.5 < high < 8


def test_montage(spark):
    df = spark.createDataFrame([(1.0, 3.0, 7.0, 2.0)], ["LEOG", "REOG", "UEOG", "DEOG"])
    assert table(montage.bipolar(df).select("H", "V"), "H") == [(2.0, 5.0)]
    assert table(montage.passthrough(df.select("LEOG", "REOG")).select("H", "V"), "H") == [(1.0, 3.0)]
    with pytest.raises(KeyError):
        montage.passthrough(df)
    assert montage.find_channel(["xLEFT", "LEOG"], ["LEOG", "LEFT"]) == "LEOG"


def recording(seed=0, fs=256, trials=20):
    random = np.random.default_rng(seed)
    control = np.concatenate([np.full(fs, 3)] + [np.concatenate([np.full(fs, 1), np.full(fs, 2), np.full(2 * fs, 3)]) for _ in range(trials)])
    target = np.zeros(len(control))
    edges = np.flatnonzero(np.diff(control)) + 1
    for a, b in zip(edges, [*edges[1:], len(control)]):
        target[a:b] = target[a - 1] if control[a] == 3 else random.uniform(-20, 20)
    gaze = np.concatenate([np.zeros(50), target[:-50]])
    gaze = np.convolve(np.pad(gaze, 4, mode="edge"), np.ones(9) / 9, mode="valid")
    bump = np.zeros(len(control))
    for a in edges[control[edges] == 3]:
        bump[a + 200 : a + 260] += 60 * np.hanning(60)
    noise = random.normal(scale=0.05, size=(2, len(control)))
    return [(0, i, int(control[i]), float(10 * gaze[i] + noise[0, i]), float(4 * gaze[i] + 8 * bump[i] + noise[1, i]), float(target[i]), float(target[i])) for i in range(len(control))]


def test_known_start_on_a_recording(spark):
    df = spark.createDataFrame(recording(), "r int, i long, control int, h double, v double, target_h double, target_v double").cache()
    moves = known_start.movements(df, ["r"], "i", 256.0).cache()
    saccades = moves.filter("not is_blink")
    assert 35 <= saccades.count() <= 44 and 15 <= moves.filter("is_blink").count() <= 24
    labels = known_start.ground_truth(df, ["r"], "i", 256.0)
    windows_ = known_start.protocol(df.join(labels, ["r", "i"]), ["r"], "i", 256.0).cache()
    assert windows_.filter("kind = 'saccade'").count() == 40 and windows_.filter("kind = 'saccade' and not mistake").count() > 30
    ends = windows_.filter("kind = 'saccade' and not mistake").select("r", "start", (F.col("end") - 1).alias("i"), "shift_h")
    disp = known_start.displacement(df, moves, ends, ["r"], "i", 256.0)
    fit = disp.agg(F.max(F.abs(F.col("disp_h") / 10 - F.col("shift_h")))).first()[0]
    assert fit < 0.5
    tail = table(known_start.displacement(df, moves, df.filter("i = 5").select("r", F.lit(0).cast("long").alias("start"), "i"), ["r"], "i", 256.0), "i")
    assert tail == [(0, 0, 5, 0.0, 0.0)]


def test_outlier_fence_is_strict_and_by_kind(spark):
    rows = [("a", "saccade", float(k), 0.0) for k in (1, 1, 1, 1)] + [("a", "blink", 0.0, 0.0)] * 4 + [("a", "blink", 1.0, 0.0)]
    out = known_start.outliers(spark.createDataFrame(rows, "s string, kind string, err_h double, err_v double"), ["s", "kind"])
    assert out.filter("outlier").count() == 1


def test_estimators(spark):
    random = np.random.default_rng(4)
    rows = [(f"S{k % 6}", float(a), float(b), float(2 * a - b), int(a + b > 0), True) for k, (a, b) in enumerate(random.normal(size=(240, 2)))]
    df = spark.createDataFrame(rows, "s string, a double, b double, y double, c int, is_fixation boolean").repartition(2).cache()
    f = folds.group_folds(df, ["s"], 2)
    out = models.cross_validated(df, f, ["s"], lambda: models.huber_regressor(["a", "b"], "y"))
    assert out.count() == 240 and out.agg(F.max(F.abs(F.col("yhat") - F.col("y")))).first()[0] < 0.1
    forest = models.forest_classifier(["a", "b"], "c", trees=4).fit(df).transform(df)
    assert forest.filter("prediction = c").count() > 220
    assert models.train_rows(df.withColumn("is_fixation", F.col("a") > 0), "weighted").agg(F.min("weight")).first()[0] == 0.2
    assert models.fourier(df, ["a", "b"], 8).columns[-1] == "rff_7"


def test_models_are_sent_in_a_session_that_has_counted(spark):
    from tidewave.llm.store import counted

    table, n = counted(spark.range(10))
    assert n == table.count() == 10 and counted(spark.range(10), F.col("id") < 4)[1] == 4 and counted(spark.range(0))[1] == 0
    df = spark.createDataFrame([(float(k % 7), float(k % 5), int(k % 7 > 3)) for k in range(70)], "a double, b double, c int")
    assert models.forest_classifier(["a", "b"], "c", trees=2).fit(df).transform(df).filter("prediction = c").count() > 60


def test_settings():
    assert load('{"known_start": {"merge_ms": 10}}').known_start == KnownStart(merge_ms=10)
    for bad, error in (({"nope": {}}, KeyError), ({"cv": {"nope": 1}}, KeyError), ({"cv": 3}, TypeError)):
        with pytest.raises(error):
            updated(Config(), bad)


def test_sources(spark, tmp_path):
    assert recordings.sampling_rate("The sampling rate was 512 Hz") == 512 and recordings.sampling_rate("") == 256
    assert recordings.column_kinds(["fs", "Target_GA_stream", "Head_Pose", "ControlSignal", "EOG_1", "note"]) == {"fs": "fs", "Target_GA_stream": "angle", "Head_Pose": "pose", "ControlSignal": "control", "EOG_1": "eog"}
    (tmp_path / "S3").mkdir()
    (tmp_path / "S3" / "x.csv").write_text("EOG_0,EOG_1\n1,2\n3,4\n")
    df = recordings.read_csv(spark, str(tmp_path), "EOG_0 double, EOG_1 double")
    assert table(recordings.long_channels(df, ["subject_id"], ["EOG_0", "EOG_1"]), "channel", "value") == [("S3", "EOG_0", 1.0), ("S3", "EOG_0", 3.0), ("S3", "EOG_1", 2.0), ("S3", "EOG_1", 4.0)]
    with pytest.raises(ValueError):
        recordings.union_all([])
    events = spark.createDataFrame([("a", 5, 3), ("b", 1, -1), ("c", 1, 2)], "s string, s1_on long, s1_end long").withColumns({c: F.lit(None).cast("long") for c in recordings.EVENTS[2:]})
    samples = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "s string, fs double")
    assert table(recordings.invalid(samples, recordings.known_events(events), ["s"]), "s") == [("a", "events not in order"), ("b", "rate not positive"), ("c", "no samples")]
