"""Values of operators that no registered query calls, against NumPy or by hand."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.config import Config, KnownStart, fingerprint
from tidewave.operators import augment, folds, metrics, montage
from tidewave.plans import regression
from tidewave.sources import recordings


def test_signs(spark):
    df = spark.createDataFrame([(r, i, v if 2 <= i < 5 else -9.0) for r, v in (("up", 3.0), ("down", -3.0), ("unknown", 1.0)) for i in range(8)], "r string, i int, x double")
    events = spark.createDataFrame([("up", 2, 5), ("down", 2, 5), ("unknown", None, None)], "r string, s1_on int, s1_end int")
    found = {r.r: (r["mean"], r.right) for r in montage.sign_check(df, events, ["r"], "i", "x").collect()}
    assert found == {"up": (3.0, True), "down": (-3.0, False), "unknown": (None, True)}
    assert {r.r: r.right for r in montage.sign_check(df, events, ["r"], "i", "x", -1.0).collect()} == {"up": False, "down": True, "unknown": True}


def test_targets_less_the_heads_turn(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0, 2.0, 5.0), ("a", 20.0, 2.0, 4.0, None), ("b", 7.0, 8.0, None, None)], "r string, target_h double, target_v double, yaw double, pitch double")
    out = sorted((r.r, r.target_h, r.target_v) for r in regression.head_corrected(df, ["r"]).collect())
    assert out == [("a", 11.0, 1.0), ("a", 19.0, 2.0), ("b", 7.0, 8.0)]
    assert regression.head_corrected(df, ["r"], False) is df


def test_rates(spark):
    df = spark.createDataFrame([(1, "x", 512.0), (2, "x", None), (3, "y", 0.0), (4, None, None)], "k int, dataset_source string, fs double")
    assert {r.k: r.fs for r in recordings.with_rates(df, {"x": 128.0}, 256.0).collect()} == {1: 512.0, 2: 128.0, 3: 256.0, 4: 256.0}
    assert {r.fs for r in recordings.with_rates(df.drop("fs"), {}, 64.0).collect()} == {64.0}


def test_losses(spark):
    random = np.random.default_rng(1)
    logits, y = random.normal(size=(50, 4)), random.integers(0, 4, 50)
    t, p = random.normal(size=(2, 50, 2)) * 2
    rows = [(int(c), [float(v) for v in l], *map(float, (a[0], a[1], b[0], b[1]))) for c, l, a, b in zip(y, logits, t, p)]
    r = metrics.losses(spark.createDataFrame(rows, "y_class int, logits array<double>, y_h double, y_v double, yhat_h double, yhat_v double"), 2.0, 0.5, 0.1).first()
    log_p = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    ce = -(0.9 * log_p[np.arange(50), y] + 0.1 * log_p.mean(axis=1)).mean()
    e = p - t
    huber = np.where(np.abs(e) <= 1, e * e / 2, np.abs(e) - 0.5).mean()
    shape = np.mean([1 - np.corrcoef(p[:, k], t[:, k])[0, 1] + abs(p[:, k].std() / t[:, k].std() - 1) for k in (0, 1)])
    assert (r.cross_entropy, r.mse, r.huber, r.range_loss, r.static) == pytest.approx((ce, (e * e).mean(), huber, huber + shape, 2 * ce + 0.5 * (e * e).mean()))


def test_mixup_mixes_pairs_of_a_batch(spark):
    rows = [(b, k, [float(k), 1.0], float(10 * k)) for b in range(40) for k in range(5)]
    df = spark.createDataFrame(rows, "b int, k int, x array<double>, y double")
    out = augment.mixup(df, ["b"], ["k"], ["x"], ["y"], 0.4, 3).collect()
    assert len(out) == 200 and all(0.5 <= r.lam <= 1 for r in out) and len({r.lam for r in out}) == 40
    assert all(r.x[0] == pytest.approx(r.lam * r.k + (1 - r.lam) * r.other_k) and r.y == pytest.approx(10 * r.x[0]) and r.x[1] == pytest.approx(1) and r.k != r.other_k for r in out)
    assert sorted(r.other_k for r in out if r.b == 7) == list(range(5))


def test_caps_and_fingerprints(spark):
    df = spark.range(500)
    first = [r.id for r in folds.capped(df, ["id"], 40, 1).collect()]
    assert len(set(first)) == 40 and first == [r.id for r in folds.capped(df.repartition(7), ["id"], 40, 1).collect()] != [r.id for r in folds.capped(df, ["id"], 40, 2).collect()]
    assert folds.capped(df, ["id"], 900, 1).count() == 500
    changed = dataclasses.replace(Config(), known_start=KnownStart(merge_ms=1.0))
    assert fingerprint(Config()) == fingerprint(Config()) != fingerprint(changed) and len(fingerprint(changed)) == 16 and fingerprint(Config(), "x") != fingerprint(Config())


def test_unreadable_lines_are_counted(spark, tmp_path):
    (tmp_path / "S1").mkdir()
    (tmp_path / "S1" / "x.csv").write_text("a,b\n1,2\nx,4\n5,6\ny,z\n")
    df = recordings.read_csv(spark, str(tmp_path), "a double, b double, _corrupt_record string").cache()
    assert [tuple(r) for r in recordings.unreadable(df, ["subject_id"]).collect()] == [("S1", "lines not readable", 2)] and df.count() == 4


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_samples_are_dealt_once(spark):
    """What is grouped by recording finds the samples where their positions were counted."""
    from pyspark.sql import functions as F

    from tidewave.sources.recordings import event_samples, line_samples

    where = "/root/testdata/sf0.001"
    for x in (line_samples(spark.read.parquet(f"{where}/lineitem.parquet")), event_samples(spark.read.parquet(f"{where}/events.parquet"))):
        assert exchanges(x.groupBy("subject", F.floor(F.col("idx") / 8)).agg(F.avg("h"))) == 1


def test_baselines_leave_samples_where_they_are(spark):
    """Joins by recording and block deal no side by both; queries of other kinds get Spark's default back."""
    import __spark_entry__ as entry

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = entry.queries()["robust_detrend"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(subject" in plan and "block#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
        entry.queries()["asof_backward"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(entry.ANEW) == "true"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset(entry.ANEW)


def test_rounding_is_that_of_the_sql(spark):
    """Values next to a half in the last place, which scaling makes a half or not."""
    import math

    import duckdb

    from tidewave import queries

    near = [v + 1.3e-6 * k for v in (27.0762137, 20.0929837, 36.0060337, 48.7913537, 52.8136737, 40.9838937) for k in (0, 1, -1)]
    values = [x for v in near for x in (math.nextafter(v, 0), v, math.nextafter(v, 100), -v)]
    found = queries.rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")).orderBy("i").collect()
    c = duckdb.connect()
    assert [r.v for r in found] == [c.execute(f"SELECT {queries.r('CAST(? AS DOUBLE)', 'v')}", [v]).fetchone()[0] for v in values]


def test_fusion_steps_as_it_is_defined():
    """To the last bit, from any state, whatever the blocks."""
    import numpy as np

    from tidewave.functions.signal import driven

    x, share, y = np.random.default_rng(1).normal(scale=40, size=(2, 700)), 0.0751, np.array([0.0, 3.0])
    found, state = driven(np.array([share]), np.array([1.0, share - 1]), x, y[:, None] * (1 - share))
    for k in range(700):
        y = y + share * (x[:, k] - y)
        assert (found[:, k] == y).all()
    assert np.allclose(state[:, 0], y * (1 - share), rtol=1e-15)
