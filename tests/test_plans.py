"""Blinks, baselines by name, feature tables, nested selection and the known-start protocol, against plain NumPy or on recordings whose answer is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import recording, series, table
from tidewave.config import Config, KnownStart, Preprocessing
from tidewave.functions.tables import settled
from tidewave.operators import blinks, drift, known_start
from tidewave.plans import known_start as protocol, regression


def test_blinks_of_the_vertical_channel(spark):
    v = np.random.default_rng(1).normal(size=600)
    v[100:140], v[300:305], v[400:460] = 60.0, 60.0, -60.0  # the second one is too short
    df = spark.createDataFrame([(r, i, float(x)) for r in ("given", "found", "flat") for i, x in enumerate(v if r != "flat" else np.zeros(600))], "r string, i long, v double")
    events = spark.createDataFrame([("given", None, 7, 9), ("found", 90, -1, -1), ("flat", None, None, None)], "r string, s1_on long, b_on long, b_end long")
    assert table(blinks.blinks(df, events, ["r"], "i", "v", 256.0), "r", "start") == [("found", 100, 140), ("found", 400, 460), ("given", 7, 10)]
    assert blinks.blink_samples(256.0) == 10 and blinks.detected_blinks(df.limit(0), ["r"], "i", "v", 256.0).count() == 0


def test_values_on_the_blink_threshold_are_not_over_it(spark):
    """Half of the values are 0 and half are x, so x is twice the deviation: no blink, however the deviation was rounded."""
    rows = [(r, i, float(r) if (i // 3 + r) % 2 else 0.0) for r in range(1, 60) for i in range(6 * (r % 11 + 1))]
    cfg = Preprocessing(blink_threshold_std=2.0, blink_min_duration_ms=8.0)
    assert blinks.detected_blinks(spark.createDataFrame(rows, "r int, i int, v double"), ["r"], "i", "v", 256.0, cfg).count() == 0
    more = rows + [(r, 6 * (r % 11 + 1), 0.0) for r in range(1, 60)]  # with one 0 more, x is over it
    assert blinks.detected_blinks(spark.createDataFrame(more, "r int, i int, v double"), ["r"], "i", "v", 256.0, cfg).select("r").distinct().count() == 59


def plain_baseline(x, step, n, clip, line):
    """The past-only robust mean or line of n blocks, as it is defined: one window at a time."""
    blocks = np.array(x[: len(x) // step * step]).reshape(-1, step).mean(axis=1)
    base = [x[0]]
    for k in range(len(blocks)):
        window = np.array([blocks[max(j, 0)] for j in range(k - n + 1, k + 1)])
        off = np.abs(window - np.median(window))
        keep = off <= max(clip, 0.68) * 1.4826 * np.median(off)
        fit = np.polyfit(np.arange(-n, 0)[keep], window[keep], 1)[1] if line and keep.sum() > 1 else window[keep].mean()
        base.append(fit)
    return np.repeat(base, step)[: len(x)]


@pytest.mark.parametrize("chunk", [4096, 7])
def test_robust_line_and_mean(spark, monkeypatch, chunk):
    """Also where a recording is cut into runs, and for a window of a minute of blocks."""
    monkeypatch.setattr(drift, "CHUNK", chunk)
    random = np.random.default_rng(3)
    x = np.cumsum(random.normal(size=230)) + np.where(random.random(230) < 0.1, 50, 0)
    for n in (5, 480):
        mean = [r[0] for r in table(drift.robust_mean(series(spark, x), ["r"], "i", "x", "y", 4, n, 3.0).select("y", "i"), "i")]
        line = [r[0] for r in table(drift.robust_line(series(spark, x), ["r"], "i", "x", "y", 4, n, 3.0).select("y", "i"), "i")]
        assert np.allclose(mean, x - plain_baseline(x, 4, n, 3.0, False)) and np.allclose(line, x - plain_baseline(x, 4, n, 3.0, True))


def test_a_line_has_no_lag(spark):
    ramp = np.arange(400.0)
    got = np.array([r[0] for r in table(drift.robust_line(series(spark, ramp), ["r"], "i", "x", "y", 8, 6).select("y", "i"), "i")])
    assert np.abs(got[80:]).max() < 5 and np.abs([r[0] for r in table(drift.robust_mean(series(spark, ramp), ["r"], "i", "x", "y", 8, 6).select("y", "i"), "i")][80:]).min() > 10


def test_baselines_by_name(spark):
    x = np.random.default_rng(4).normal(size=300) + np.linspace(0, 9, 300)
    cfg = Preprocessing(baseline_window_sec=1.0, median_baseline_sec=1.0, baseline_clip_mad=2.0)
    for method in ("highpass", "polynomial_detrend", "moving_median", "robust_mean", "robust_line"):
        for causal in (False, True):
            out = drift.remove_baseline(series(spark, x), ["r"], "i", "x", "y", 64.0, cfg, method, causal=causal)
            assert set(out.columns) >= {"r", "i", "x", "y"} and abs(out.agg(F.avg("y")).first()[0]) < 2.5
    with pytest.raises(ValueError):
        drift.remove_baseline(series(spark, x), ["r"], "i", "x", "y", 64.0, cfg, "nope")
    step, n = 8, 8
    tops = np.array(x)[::step]
    padded = np.concatenate([np.full(n // 2, tops[0]), tops, np.full(n - n // 2 - 1, tops[-1])])
    middle = [sorted(padded[k : k + n])[n // 2] for k in range(len(tops))]
    got = [r[0] for r in table(drift.remove_baseline(series(spark, x), ["r"], "i", "x", "y", 64.0, cfg, "moving_median", causal=False).select("y", "i"), "i")]
    assert np.allclose(got, x - np.interp(np.arange(300), np.arange(len(tops)) * step, middle))


@pytest.fixture(scope="module")
def recordings(spark):
    """Three subjects' recordings of one protocol, with gains of their own and a still head."""
    rows = []
    for s, gain in enumerate((1.0, 1.5, 0.7)):
        rows += [(s, i, control, gain * h, gain * v, th, tv, 1.0, 2.0) for _, i, control, h, v, th, tv in recording(trials=8)]
    return spark.createDataFrame(rows, "subject int, i long, control int, h double, v double, target_h double, target_v double, yaw double, pitch double").repartition(3, "subject").cache()


def test_known_start_protocol(spark, recordings):
    by, fs = ["subject"], 256.0
    cfg = KnownStart(n_subsets=2, long_trials=2, long_segments=2)
    df = settled(recordings.join(known_start.ground_truth(recordings, by, "i", fs), [*by, "i"]))
    events, windows = settled(known_start.movements(recordings, by, "i", fs)), settled(known_start.protocol(df, by, "i", fs))
    rotation = settled(protocol.head_rotation(recordings, events, by, "i", fs, cfg))
    assert rotation.agg(F.max(F.abs("rot_h"))).first()[0] < 1e-6
    errors = settled(protocol.protocol_errors(df, events, windows, "subject", by, "i", fs, cfg, rotation)[0])
    got = {(r.fit, r.length, r.estimator): r for r in protocol.protocol_table(errors, cfg).collect()}
    assert set(got) == {(f, n, e) for f in ("same_subject", "unseen_subject") for n, e in (("short", "saccades"), ("short", "level"), ("short", "saccades_vor"), ("long", "saccades"), ("long", "saccades_vor"))}
    assert all(got[f, n, "saccades"].excluded_mae_h_deg < (0.6 if n == "short" else 3.0) for f in ("same_subject", "unseen_subject") for n in ("short", "long"))
    assert abs(got["same_subject", "short", "saccades"].mae_h_deg - got["same_subject", "short", "saccades_vor"].mae_h_deg) < 1e-6
    stats = protocol.protocol_stats(df, events, windows, by, fs, cfg).first()
    assert stats.detector_cue_recall > 0.85 and stats.detector_event_precision > 0.85 and abs(stats.label_fixation_fraction + stats.label_saccade_fraction + stats.label_blink_fraction - 1) < 1e-9
    found = blinks.disagreements(windows, events, known_start.mask_runs(df, by, "i", F.col("label") == 2), by)
    assert found.count() == windows.count() and found.filter("disagrees").count() < 0.1 * windows.count()


def test_fused_segments_equal_plain_loops(spark, recordings):
    """Planes by lstsq, the leaky pull sample by sample, time constants by trying each: for every fit within and across subjects."""
    by, fs, taus = ["subject"], 256.0, (0.5, 5.0, float("inf"))
    cfg = KnownStart(n_subsets=2, long_trials=2, long_segments=2, short_saccade_windows=3, short_blink_windows=1, taus_sec=taus)
    df = settled(recordings.join(known_start.ground_truth(recordings, by, "i", fs), [*by, "i"]))
    events, windows = settled(known_start.movements(recordings, by, "i", fs)), settled(known_start.protocol(df, by, "i", fs))
    absolute = settled(df.select(*by, "i", F.when(F.col("i") % 3000 > 500, F.col("target_h") + F.sin("i") + F.col("subject")).alias("absolute_h"), (F.col("target_v") + 30).alias("absolute_v")))
    errors, chosen = protocol.protocol_errors(df, events, windows, "subject", by, "i", fs, cfg, absolute=absolute)
    got = sorted((r.fit, r.length, r.subject, r.kind, r.err_h, r.err_v) for r in errors.filter("estimator = 'fused'").collect())

    dealt = settled(protocol.dealt_windows(windows, by, cfg))
    scored = settled(protocol.scored_samples(df, dealt, by, "i"))
    idx, segments = {}, {}
    for r in scored.collect():
        idx.setdefault((r.subject, r.window), []).append(r.i)
    for w in sorted(dealt.collect(), key=lambda w: (w.subject, w.start)):
        for length, kind, number in ([("short", w.kind, w.start)] if w.short else []) + ([("long", "segment", f"run {w.long}")] if w.long is not None else []):
            seg = segments.setdefault((w.subject, length, w.part, number), {"kind": kind, "start": w.start, "gaze": np.array([w.gaze_h, w.gaze_v]), "idx": []})
            seg["idx"] += sorted(idx.get((w.subject, w.start), []))
    segments = {k: v for k, v in segments.items() if v["idx"]}
    spans = spark.createDataFrame([(k[0], v["start"], max(v["idx"])) for k, v in segments.items()], "subject int, start long, last long").distinct()
    moved = {(r.subject, r.start, r.i): np.array([r.disp_h, r.disp_v]) for r in known_start.displacement(df, events, spans.select("subject", "start", F.explode(F.sequence("start", "last")).alias("i")), by, "i", fs, cfg).collect()}
    aim = {(r.subject, r.i): np.array([np.nan if r.absolute_h is None else r.absolute_h, r.absolute_v]) for r in absolute.collect()}
    target = {(r.subject, r.i): np.array([r.target_h, r.target_v]) for r in df.select("subject", "i", "target_h", "target_v").collect()}
    gains = {r.subject: np.array([r.gain_h, r.gain_v]) for r in known_start.label_free_gain(events, by).collect()}
    pairs = {(r.subject, r.window): (np.array([r.x_h, r.x_v]), np.array([r.shift_h, r.shift_v])) for r in protocol.training_pairs(df, events, dealt, scored, by, "i", fs, cfg).filter("estimator = 'saccades'").collect()}
    place = {(w.subject, w.start): w for w in dealt.collect()}
    fit = lambda keys, gain: np.linalg.lstsq(np.array([pairs[k][0] / gain(k) for k in keys]), np.array([pairs[k][1] for k in keys]), rcond=None)[0].T

    def error(key, a, gain):
        """(time constants, axes) mean errors of a segment."""
        s, seg = key[0], segments[key]
        span = range(seg["start"], max(seg["idx"]) + 1)
        base = np.array([seg["gaze"] + a @ (moved[s, seg["start"], i] / gain) for i in span])
        off = np.nan_to_num(np.array([aim[s, i] for i in span]) - base)
        out = []
        for tau in taus:
            y, share, drawn = np.zeros(2), 1 - np.exp(-1 / (tau * fs)), []
            for x in off:
                y = y + share * (x - y)
                drawn.append(y)
            out.append(np.mean([abs(base[i - seg["start"]] + drawn[i - seg["start"]] - target[s, i]) for i in seg["idx"]], axis=0))
        return np.array(out)

    want, constants = [], []
    def score(name, length, fitted, tested, a, gain):
        mean = np.mean([error(k, a, gain(k)) for k in fitted], axis=0) if fitted else None
        best = mean.argmin(axis=0) if fitted else [len(taus) - 1] * 2
        constants.extend((name, length, axis, taus[b]) for axis, b in zip("hv", best))
        for k in tested:
            e = error(k, a, gain(k))
            want.append((name, length, k[0], segments[k]["kind"], e[best[0], 0], e[best[1], 1]))

    of = lambda s, length, part: [k for k in segments if (s is None or k[0] == s) and k[1] == length and (part is None or k[2] == part)]
    for s in range(3):
        for length in ("short", "long"):
            for part in range(2):
                inside = [k for k in pairs if k[0] == s and place[k].part == part and (place[k].short if length == "short" else place[k].long is not None)]
                score("same_subject", length, of(s, length, part), of(s, length, 1 - part), fit(inside, lambda k: 1.0), lambda k: 1.0)
            others = [k for k in pairs if k[0] != s and place[k].short]
            score("unseen_subject", length, [k for k in of(None, length, None) if k[0] != s], of(s, length, None), fit(others, lambda k: gains[k[0]]), lambda k: gains[k[0]])
    assert len(want) == len(got) > 30 and all(g[:4] == w[:4] and np.allclose(g[4:], w[4:], atol=1e-6) for g, w in zip(got, sorted(want)))
    assert sorted((r.fit, r.length, r.axis, r.tau) for r in chosen.collect()) == sorted(constants)
    assert {(r.fit, r.length, r.axis) for r in protocol.tau_counts(chosen).collect()} == {(f, n, a) for f in ("same_subject", "unseen_subject") for n in ("short", "long") for a in "hv"}


def test_fusion_is_a_leaky_pull(spark):
    n, fs = 300, 64.0
    rows = [(0, k, 0.0, 0.0, 4.0 if k >= 50 else None, -2.0) for k in range(n)]
    df = spark.createDataFrame(rows, "s int, i long, base_h double, base_v double, absolute_h double, absolute_v double")
    got = {(r.tau, r.i): (r.yhat_h, r.yhat_v) for r in protocol.fused(df, ["s"], "i", fs, (1.0, float("inf"))).collect()}
    share = 1 - np.exp(-1 / fs)
    assert got[1.0, 49][0] == 0 and got[float("inf"), n - 1] == (0.0, 0.0)
    assert got[1.0, n - 1][1] == pytest.approx(-2 * (1 - (1 - share) ** n)) and got[1.0, n - 1][0] == pytest.approx(4 * (1 - (1 - share) ** (n - 50)))


def test_feature_matrix_and_nested_selection(spark, recordings):
    cfg = Config(preprocessing=Preprocessing(drift_removal_method="robust_mean", baseline_window_sec=5.0, context_baselines=(("robust_line", 5.0),), context_lags_sec=(0.5,), context_range_windows_sec=(15.0,), context_head_pose=False))
    events = recordings.select("subject").distinct().withColumn("s1_on", F.lit(None).cast("long"))
    m = settled(regression.feature_matrix(recordings, events, ["subject"], ["subject"], "i", ["h", "v"], 256.0, cfg, engineered=False))
    names = regression.context_names(["h", "v"], cfg.preprocessing)
    assert m.columns == ["subject", "window_start", "y_h", "y_v", "is_fixation", *names] and len(names) == 2 + 2 + 2 * 2 * 3
    assert m.count() == recordings.select("subject").distinct().count() * len(range(0, recordings.filter("subject = 0").count() - 77 + 1, 38))
    constant = lambda c: lambda train, rows: rows.withColumns({"yhat_h": F.lit(c), "yhat_v": F.lit(c)})
    out, chosen = regression.nested(m.select("subject", "y_h", "y_v", "is_fixation"), ["subject"], {"far": constant(90.0), "near": constant(0.0)}, 2, 2)
    assert {r.candidate for r in chosen.collect()} == {"near"} and out.count() == m.count() and out.filter("yhat_h <> 0").count() == 0
    scores = regression.anchored_scores(m.select("subject", "window_start", "y_h", "y_v", "is_fixation").withColumns({"yhat_h": F.col("y_h") + 5, "yhat_v": F.col("y_v")}), ["subject"], ["subject"], 256.0, (10.0,)).collect()
    assert {(r.estimate, round(r.score_fixation, 6)) for r in scores} == {("anchored", 0.0), ("plain", 2.5)}


def test_scenarios(spark):
    cues = spark.createDataFrame([(0, k, float(h), float(v), float(h), float(v)) for k, (h, v) in enumerate([(3, 3), (-3, 3), (3, -3), (1, 1), (0, 0)], 1)], "s int, trial int, p1_h double, p1_v double, p2_h double, p2_v double")
    kept = lambda *a, **b: [r.trial for r in regression.kept_trials(cues, ["s"], *a, **b).orderBy("trial").collect()]
    assert kept("full") == [1, 2, 3, 4, 5] and kept("right") == [1, 3, 4] and kept("top") == [1, 2, 4] and kept("centre") == [4, 5]
    block = kept("block", n=3, seed=2)
    assert len(kept("random", n=2)) == 2 and kept("random", n=2) == kept("random", n=2) and block == list(range(block[0], block[0] + 3))
    with pytest.raises(ValueError):
        kept("nope")


def test_others_errors_equal_each_segment_under_each_plane(spark):
    """The sums of coefficients and the samples of open sign, against every segment under every plane: near planes, far ones, one that is null, terms that are null or not finite."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(9):
        for start in range(3):
            for i in range(6):
                for tau in (0.5, float("inf")):
                    x = rng.normal(size=12).tolist()
                    x[0] = None if (s, start, i) == (2, 1, 3) else float("nan") if (s, start) == (4, 2) and tau == 0.5 else x[0]
                    rows.append((s, "long" if start == 2 else "short", 0, start, "saccade", i, *x, tau))
    names = ["gaze_h", "gaze_v", "target_h", "target_v", "vor_h", "vor_v", "pull_h", "pull_v", "disp_h", "disp_v", "_1", "_2"]
    terms = spark.createDataFrame(rows, "subject int, length string, part int, start int, kind string, i int, " + ", ".join(f"{n} double" for n in names) + ", tau double")
    terms = settled(terms.drop("_1", "_2").withColumns({f"lag_{a}{b}": F.sin(F.col("i") + k) for k, (a, b) in enumerate(("hh", "hv", "vh", "vv"))}))
    segment, at = ["subject", "length", "part", "start", "kind"], ["fit_subject", "length", "tau"]
    for spread in (0.001, 2.0):
        planes = [(s, *(None if s == 7 else float(x) for x in 1 + spread * rng.normal(size=4))) for s in range(10)]  # subject 9 has no segments
        planes = settled(spark.createDataFrame(planes, "fit_subject int, a_hh double, a_hv double, a_vh double, a_vv double"))
        own = settled(protocol._fused_errors(terms.join(planes.withColumnRenamed("fit_subject", "subject"), "subject"), segment))
        got = {r[:3]: r[3:] for r in protocol.others_errors(terms, own, planes, "subject", segment).select(*at, "err_h", "err_v").collect()}
        every = protocol._fused_errors(terms.crossJoin(planes), [*segment, "fit_subject"]).filter("fit_subject <> subject")
        want = {r[:3]: r[3:] for r in every.groupBy(*at).agg(F.avg("err_h"), F.avg("err_v")).collect()}
        assert got.keys() == want.keys() and len(want) == 40
        for k in want:
            assert [x is None for x in got[k]] == [x is None for x in want[k]]
            np.testing.assert_allclose([x for x in got[k] if x is not None], [x for x in want[k] if x is not None], atol=1e-9)


def test_values_on_the_threshold_are_decided_as_the_sql_does(spark, tmp_path):
    """Recordings of zeros and as many of a number, whose order decides which way the deviation is rounded."""
    import duckdb
    import tidewave.queries as registered

    random, c = np.random.default_rng(4), duckdb.connect(config={"threads": 1})
    rows = [(r, int(k)) for r in range(1, 90) for k in random.permutation([0] * (r % 13 + 9) + [r] * (r % 13 + 9))]
    c.execute("CREATE TABLE made (user_id BIGINT, k BIGINT)")
    c.executemany("INSERT INTO made VALUES (?, ?)", rows)
    c.execute(f"""COPY (SELECT rowid AS event_id, TIMESTAMP '2024-01-01' + to_seconds(rowid) AS ts, user_id, 'view' AS event_type, 1.5 AS value, '{{"k": ' || k || '}}' AS props FROM made ORDER BY hash(rowid)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    c.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    expected = sorted(c.execute(registered.ORACLE["detected_blinks"]).fetchall())
    found = registered.QUERIES["detected_blinks"](spark, str(tmp_path)).select("subject", "start", "end")
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 0


def test_fusion_passes_over_nulls_as_the_sql_does(spark, tmp_path):
    """Samples without a value, at starts and within windows too, and a recording of nothing else."""
    import duckdb
    import tidewave.queries as registered

    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 7 > 0 AND user_id % 5 > 0 THEN value END AS value) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    for name, columns in (("fused_estimates", ["subject", "idx", "tau", "yhat_h", "yhat_v"]), ("absolute_series", ["subject", "idx", "absolute_h", "absolute_v"])):
        expected = sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({registered.ORACLE[name]})").fetchall(), key=key)
        assert sorted((tuple(r) for r in registered.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=key) == expected


def test_a_baseline_is_found_once_and_in_batches(spark, monkeypatch):
    """A feature table asks for each baseline of each channel once; runs that lie in several batches, of several recordings, equal plain loops."""
    from tidewave.config import Config
    from tidewave.plans import regression

    random, asked, remove = np.random.default_rng(3), [], drift.remove_baseline
    monkeypatch.setattr(regression.drift, "remove_baseline", lambda *a, **k: asked.append(1) or remove(*a, **k))
    df = spark.createDataFrame([(r, i, i // 60 % 3 + 1, *map(float, random.normal(size=4))) for r in ("a", "b") for i in range(700)], "r string, i long, control int, h double, v double, target_h double, target_v double")
    pp = Preprocessing(drift_removal_method="robust_line", baseline_causal=True, baseline_window_sec=1.0, context_baselines=(("robust_mean", 0.5),))
    events = df.select("r").distinct().withColumn("s1_on", F.lit(None).cast("long"))
    assert regression.feature_matrix(df, events, ["r"], ["r"], "i", ["h", "v"], 128.0, Config(preprocessing=pp), engineered=False).count() > 0 and len(asked) == 4
    monkeypatch.setattr(drift, "CHUNK", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        base = drift.robust_baseline(df, ["r"], "i", "h", 4, 6)
        assert "InPandas" not in base._jdf.queryExecution().toString()
        found = {(r.r, r.block): r.base for r in base.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 350
    for name in ("a", "b"):
        x = [r.h for r in df.filter(F.col("r") == name).orderBy("i").collect()]
        m = np.array(x).reshape(-1, 4).mean(axis=1)
        assert [found[name, k] for k in range(175)] == pytest.approx(drift._baselines(np.append(np.full(5, m[0]), m), 6, 1.0, False).tolist())
