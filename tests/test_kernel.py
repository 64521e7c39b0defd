"""Kernel machines against plain minimisers, and grid searches against searches made of single fits."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidewave.operators import folds, kernel, models


def objective(z, y, w, c, epsilon):
    """The loss as it is defined, not rounded off."""
    over = 1 - y * (z @ w) if epsilon is None else np.abs(y - z @ w) - epsilon
    return w[:-1] @ w[:-1] / 2 + c * np.maximum(over, 0).sum()


def least(z, y, c, epsilon, steps=30000):
    """The best of many subgradient steps."""
    w, best = np.zeros(z.shape[1]), np.inf
    for k in range(1, steps):
        if epsilon is None:
            slope = z.T @ np.where(1 - y * (z @ w) > 0, -y, 0)
        else:
            e = z @ w - y
            slope = z.T @ (np.sign(e) * (np.abs(e) > epsilon))
        w = w - (np.append(w[:-1], 0) + c * slope) / (k**0.75 + c * len(z))
        best = min(best, objective(z, y, w, c, epsilon))
    return best


@pytest.mark.parametrize("epsilon", [None, 0.1])
def test_machine_minimises_its_loss(spark, epsilon):
    random = np.random.default_rng(3)
    x = random.normal(size=(90, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + random.normal(scale=0.3, size=90)
    y = (y > 0).astype(float) if epsilon is None else y
    rows = spark.createDataFrame([(a.tolist(), [float(b)], 1.0, 0, 0) for a, b in zip(x, y)], "x array<double>, y array<double>, weight double, fold int, inner int").repartition(3)
    view = kernel.View(-1, -1, np.zeros(3), np.ones(3), np.ones(2))
    machines = [kernel.Machine(0, 0 if epsilon is not None else 1, c, epsilon) for c in (0.1, 1.0)]
    z, target = np.append(x, np.ones((90, 1)), axis=1), np.where(y == 1, 1.0, -1.0) if epsilon is None else y
    for machine, w in zip(machines, kernel.fitted(rows, [view], machines)):
        c = machine.c
        assert objective(z, target, w, c, epsilon) <= least(z, target, c, epsilon) * 1.01 + c * 90 * kernel.SMOOTH / 2 * 0.1


def ring(spark, n=400):
    random = np.random.default_rng(1)
    radius, angle = np.where(np.arange(n) % 2, 2.0, 0.7) + random.normal(scale=0.15, size=n), random.uniform(0, 2 * np.pi, n)
    rows = [(f"s{k // 2 % 8}", k, float(r * np.cos(a)), float(r * np.sin(a)), k % 2, float(r)) for k, (r, a) in enumerate(zip(radius, angle))]
    return spark.createDataFrame(rows, "s string, k int, a double, b double, label int, r double").repartition(2).cache()


def test_pipelines_bend_where_a_line_cannot(spark, tmp_path):
    df = ring(spark)
    line = models.huber_regressor(["a", "b"], "r").fit(df).transform(df)
    model = models.kernel_classifier(["a", "b"], "label", 2).fit(df)
    assert model.transform(df).filter("prediction = label").count() > 390
    curve = models.kernel_regressor(["a", "b"], "r", c=10.0).fit(df)
    error = lambda x: x.agg(F.avg(F.abs(F.col("prediction") - F.col("r")))).first()[0]
    assert error(curve.transform(df)) < error(line) / 3
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    both = [{r.k: r.prediction for r in m.transform(df).collect()} for m in (model, again)]
    assert both[0] == both[1]


def test_map_approximates_the_kernel():
    x = np.random.default_rng(0).normal(size=(20, 3))
    z = kernel.fourier_map(x, 20000, 0.0, 1)
    assert np.abs(z @ z.T - np.exp(-((x[:, None] - x) ** 2).sum(axis=2) / 3)).max() < 0.05


def test_search_equals_single_fits(spark):
    df = ring(spark, 160).withColumn("r2", F.col("a") * F.col("b"))
    outer, inner = folds.group_folds(df, ["s"], 2), folds.group_folds(df, ["s"], 3)
    grid = [(0.01, 0.1), (1.0, 0.1), (1.0, 3.0)]
    fit = lambda x, f, g: kernel.regression_cv(x, f, ["s"], ["s", "k"], ["a", "b"], ["r", "r2"], g, n=24)
    found = fit(df, outer, grid).cache()
    one, two = (F.pow(F.col(f"yhat_{c}") - F.col(c), 2) for c in ("r", "r2"))
    rest = df.join(outer.filter("fold <> 0"), "s").drop("fold")
    scores = []
    for g in grid:
        each = fit(rest, inner, [g]).groupBy("fold").agg(F.avg((one + two) / 2).alias("e")).collect()
        scores.append(float(np.mean([r.e for r in each])))
    row = found.filter("fold = 0").first()
    assert (row.c, row.epsilon) == grid[int(np.argmin(scores))] and abs(row.score - min(scores)) < 1e-6
    alone = {r.k: (r.yhat_r, r.yhat_r2) for r in fit(df, outer, [(row.c, row.epsilon)]).filter("fold = 0").collect()}
    assert found.count() == 160 and all(np.allclose(alone[r.k], (r.yhat_r, r.yhat_r2), atol=1e-8) for r in found.filter("fold = 0").collect())


def test_a_fold_learns_nothing_of_its_own(spark):
    df = ring(spark, 160)
    outer = folds.group_folds(df, ["s"], 2)
    fit = lambda x: kernel.classification_cv(x, outer, ["s"], ["k"], ["a", "b"], "label", 2, [0.1, 1.0], inner=2, n=24)
    changed = df.join(outer, "s").withColumn("label", F.when(F.col("fold") == 0, 0).otherwise(F.col("label"))).drop("fold")
    plain, other = ({r.k: (r.yhat, r.c) for r in fit(x).filter("fold = 0").collect()} for x in (df, changed))
    assert plain == other and len(plain) > 0
    assert fit(df).filter("y = yhat").count() > 150


def test_gaps_weights_and_empty_tables(spark):
    df = ring(spark, 80)
    outer = folds.group_folds(df, ["s"], 2)
    gaps = df.withColumns({"a": F.when(F.col("k") % 9 > 0, F.col("a")), "b": F.when(F.col("k") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("b")), "none": F.lit(None).cast("double"), "same": F.lit(2.0), "r": F.when(F.col("k") % 10 > 0, F.col("r")), "w": F.when(F.col("k") % 7 > 0, 1.0)})
    fit = lambda x, **more: kernel.regression_cv(x, outer, ["s"], ["k"], ["a", "b", "none", "same"], ["r"], n=16, **more)
    rows = fit(gaps, weight="w").collect()
    assert sorted(r.k for r in rows) == [k for k in range(80) if k % 10] and all(np.isfinite(r.yhat_r) and r.score is None for r in rows)
    wild = gaps.withColumn("r", F.when(F.col("w").isNull() & F.col("r").isNotNull(), 1e6).otherwise(F.col("r")))
    assert [round(r.yhat_r, 6) for r in sorted(fit(wild, weight="w").collect())] == [round(r.yhat_r, 6) for r in sorted(rows)]
    assert fit(gaps.limit(0)).collect() == [] and fit(gaps.limit(0), grid=[(1.0, 0.1), (2.0, 0.1)]).collect() == []
    one = kernel.classification_cv(df.withColumn("label", F.lit(1)), outer, ["s"], ["k"], ["a", "b"], "label", 3, n=16)
    assert {r.yhat for r in one.collect()} == {1}


@pytest.mark.parametrize("epsilon", [None, 0.1])
def test_many_rows_are_read_few_times(spark, monkeypatch, epsilon):
    """Machines of many rows end as well as those that start from zero, after few passes over all rows."""
    monkeypatch.setattr(kernel, "FEW", 400)
    x = np.random.default_rng(5).normal(size=(7000, 3))
    y = x @ [1.0, -2.0, 0.5] + np.random.default_rng(6).normal(scale=0.8, size=7000)
    y = (y > 0).astype(float) if epsilon is None else y
    rows = spark.createDataFrame([(a.tolist(), [float(b)], 1.0, 0, 0) for a, b in zip(x, y)], "x array<double>, y array<double>, weight double, fold int, inner int").repartition(3).cache()
    views, machines = [kernel.View(-1, -1, np.zeros(3), np.ones(3), np.ones(2))], [kernel.Machine(0, int(epsilon is None), c, epsilon) for c in (0.1, 10.0)]
    passes, added = [], kernel._added
    monkeypatch.setattr(kernel, "_added", lambda rows, sums: passes.append(rows.count()) or added(rows, sums))
    found = kernel.fitted(rows, views, machines)
    full = passes.count(7000)
    plain = kernel._fitted(rows, views, machines, np.zeros((2, 4)), 0, 0.0, 42)
    z, target = np.append(x, np.ones((7000, 1)), axis=1), np.where(y == 1, 1.0, -1.0) if epsilon is None else y
    for m, a, b in zip(machines, found, plain):
        assert abs(objective(z, target, a, m.c, epsilon) / objective(z, target, b, m.c, epsilon) - 1) < 1e-3
    assert min(passes) < 1000 and full < passes.count(7000) - full


def test_a_share_of_many_rows_has_a_share_of_its_own(spark, monkeypatch):
    """Each share is smaller than what it is drawn from, so that drawing ends; rows that are all alike, which are drawn together or not at all, end too."""
    monkeypatch.setattr(kernel, "FEW", 10)
    x = np.random.default_rng(8).normal(size=(3000, 2))
    views, machines = [kernel.View(-1, -1, np.zeros(2), np.ones(2), np.ones(1))], [kernel.Machine(0, 0, 1.0, 0.1)]
    table = lambda rows: spark.createDataFrame(rows, "x array<double>, y array<double>, weight double, fold int, inner int").repartition(2).cache()
    rows = table([(a.tolist(), [float(a[0] - 2 * a[1])], 1.0, 0, 0) for a in x])
    counts, fitted = [], kernel._fitted
    monkeypatch.setattr(kernel, "_fitted", lambda rows, *more: counts.append(rows.count()) or fitted(rows, *more))
    w = kernel.fitted(rows, views, machines)
    assert len(counts) == 3 and counts == sorted(counts) and counts[0] < counts[1] / 4 and counts[2] == 3000
    assert np.abs(w[0] - [1, -2, 0]).max() < 0.1
    assert abs(kernel.fitted(table([([1.0, 2.0], [3.0], 1.0, 0, 0)] * 200), views, machines)[0] @ [1, 2, 1] - 3) < 0.2


def test_rows_are_dealt_to_all_cores(spark, monkeypatch):
    """Of a table that arrives in one partition too."""
    seen, added = [], kernel._added
    monkeypatch.setattr(kernel, "_added", lambda rows, sums: seen.append(rows.rdd.getNumPartitions()) or added(rows, sums))
    df = ring(spark, 80).coalesce(1)
    kernel.regression_cv(df, folds.group_folds(df, ["s"], 2), ["s"], ["k"], ["a", "b"], ["r"], n=8).count()
    assert min(seen) >= spark.sparkContext.defaultParallelism
