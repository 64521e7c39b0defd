"""Support vector machines with a radial kernel over feature tables: random Fourier maps under linear machines, of which many are fitted in the same passes.

A machine minimises |w|^2 / 2 + c * the sum of weighted losses: the hinge of its class against the rest, or what an error exceeds epsilon by, both rounded off over SMOOTH.
A pass adds up every machine's loss, gradient and curvature over the rows that it learns from; the driver takes one Newton step for each, halved until the loss falls. All
folds, candidates and outputs of a grid search advance together, so a search reads the rows ROUNDS times at most for each lot of machines, however many rows there are. Machines of many rows
start where those of a share of them ended, which leaves few passes over all rows; they end where they would have from zero. What a task sends
is 8 * (components + 1)^2 bytes a machine, and SENT at most at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tidewave.functions.tables import byte_batches, settled
from tidewave.operators.folds import group_folds

#: Losses are quadratic over this much beyond their kink.
SMOOTH = 0.05
#: Passes at most, and the share of its loss that a machine's next step may still gain.
ROUNDS, GAIN = 80, 1e-5
#: Bytes of sums that a task sends, and tasks that add them up.
SENT, ADDERS = 1 << 24, 8
#: One row in so many finds where machines start, if those are so many at least; tasks for each core that rows are dealt to.
SHARE, FEW, TASKS = 16, 4_096, 1


class View(NamedTuple):
    """The rows that a machine learns from, those of neither fold left out (-1: none is), and how it sees them."""

    outer: int
    inner: int
    mean: np.ndarray
    scale: np.ndarray
    balance: np.ndarray  # weight of each class; [1] without classes


class Machine(NamedTuple):
    """view: its place in the views; output: the target, or the class told from the rest (epsilon None)."""

    view: int
    output: int
    c: float
    epsilon: float | None


def basis(width: int, n: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.normal(scale=math.sqrt(2 * gamma), size=(width, n)), random.uniform(0, 2 * math.pi, n)


def fourier_map(x: np.ndarray, n: int, gamma: float, seed: int) -> np.ndarray:
    """n cosines of each row of x, whose products approximate exp(-gamma * distance^2); gamma 0 is one over the number of columns."""
    w, b = basis(x.shape[1], n, gamma or 1.0 / x.shape[1], seed)
    return math.sqrt(2.0 / n) * np.cos(x @ w + b)


def terms(z: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, epsilon: float | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of w over rows z with targets y (-1 or 1 for a hinge)."""
    guess = z @ w
    if epsilon is None:
        over, sign = 1 - y * guess, -y
        far = 2 * np.maximum(np.abs(over), SMOOTH)
    else:
        over, sign = np.abs(y - guess) - epsilon, np.sign(guess - y)
        far = np.maximum(over + epsilon, SMOOTH)
    slope = np.clip(over / SMOOTH, 0, 1)
    loss = np.where(over < SMOOTH, slope * np.maximum(over, 0) / 2, over - SMOOTH / 2)
    bend = weight * np.maximum(((over > 0) & (over < SMOOTH)) / SMOOTH, slope / far)
    at = np.flatnonzero(bend)
    return float(weight @ loss), z.T @ (weight * slope * sign), (z[at] * bend[at, None]).T @ z[at]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A column of arrays of one length; null components are not a number."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def seen(x: np.ndarray, view: View, n: int, gamma: float, seed: int) -> np.ndarray:
    """x as view sees it: standardised, components that aren't finite at the mean, mapped if n > 0, and a constant."""
    z = np.nan_to_num((x - view.mean) / view.scale, nan=0.0, posinf=0.0, neginf=0.0)
    return np.append(fourier_map(z, n, gamma, seed) if n else z, np.ones((len(z), 1)), axis=1)


def _added(rows: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over tasks of what sums gives of a task's rows."""
    kind = ["sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sums(batches).tobytes()], pa.binary())], kind)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                part = np.frombuffer(value.as_buffer())
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], kind)

    adders = min(ADDERS, math.isqrt(rows.rdd.getNumPartitions() - 1) + 1) if rows.rdd.getNumPartitions() else 1
    parts = rows.mapInArrow(run, "sums binary").repartition(adders).mapInArrow(add, "sums binary").collect()  # ADDERS rows at most
    return sum(np.frombuffer(r.sums) for r in parts)


def fitted(rows: DataFrame, views: list[View], machines: list[Machine], n: int = 0, gamma: float = 0.0, seed: int = 42, gain: float = GAIN, depth: int = 0) -> np.ndarray:
    """Coefficients (machines by components and constant) over rows (x array, y array, weight, fold, inner), whose next step would gain no more than a share gain of their loss. The constant is not held down. A machine without rows is 0.
    depth: how many times rows are a share of a share already; each share is drawn by a hash of its own."""
    if not machines:
        return np.zeros((0, 0))
    byte_batches(rows.sparkSession)
    width = (n or len(views[0].mean)) + 1
    start = np.zeros((len(machines), width))
    every = rows.count()
    if every >= SHARE * FEW:
        part = settled(rows.filter(F.pmod(F.xxhash64("x", "y", F.lit(seed + depth)), F.lit(SHARE)) == 0).withColumn("weight", F.col("weight") * SHARE))
        if 2 * part.count() <= every:  # rows that are alike are drawn together
            start = fitted(part, views, machines, n, gamma, seed, GAIN * SHARE, depth + 1)
    most = max(1, SENT // (8 * width * (width + 1)))
    return np.concatenate([_fitted(rows, views, machines[i : i + most], start[i : i + most], n, gamma, seed, gain) for i in range(0, len(machines), most)])


def _fitted(rows: DataFrame, views: list[View], machines: list[Machine], start: np.ndarray, n: int, gamma: float, seed: int, gain: float = GAIN) -> np.ndarray:
    """Coefficients from those of start on."""
    count, width = start.shape
    size = 1 + width + width * width
    held = np.append(np.ones(width - 1), 1e-9)
    best, step, length = start.copy(), np.zeros((count, width)), np.ones(count)
    loss, todo = np.full(count, np.inf), list(range(count))
    for _ in range(ROUNDS):
        tried = best + length[:, None] * step
        trial = [(machines[i], tried[i]) for i in todo]

        def sums(batches: Iterator[pa.RecordBatch], trial=trial) -> np.ndarray:
            out = np.zeros((len(trial), size))
            for batch in (b for b in batches if len(b)):
                x, y = (_matrix(batch.column(c), len(batch)) for c in ("x", "y"))
                weight, fold, inner = (np.asarray(batch.column(c)) for c in ("weight", "fold", "inner"))
                for at in sorted({m.view for m, _ in trial}):
                    view = views[at]
                    keep = np.flatnonzero((fold != view.outer) & (inner != view.inner) & (weight > 0))
                    if not len(keep):
                        continue
                    z = seen(x[keep], view, n, gamma, seed)
                    for k, (m, w) in enumerate(trial):
                        if m.view == at:
                            target, share = y[keep, m.output if m.epsilon is not None else 0], weight[keep] * m.c
                            if m.epsilon is None:
                                target, share = np.where(target == m.output, 1.0, -1.0), share * view.balance[target.astype(int)]
                            a, b, c = terms(z, target, share, w, m.epsilon)
                            out[k] += np.concatenate([[a], b, c.ravel()])
            return out.ravel()

        found, left = np.reshape(_added(rows, sums), (len(trial), size)), []
        for i, part in zip(todo, found):
            now = part[0] + held @ tried[i] ** 2 / 2
            if now <= loss[i]:
                best[i], loss[i], length[i] = tried[i], now, 1.0
                slope = part[1 : 1 + width] + held * best[i]
                step[i] = -np.linalg.solve(part[1 + width :].reshape(width, width) + np.diag(held), slope)
                if -slope @ step[i] > gain * now:
                    left.append(i)
            else:
                length[i] /= 2
                if length[i] > 1e-6:
                    left.append(i)
        todo = left
        if not todo:
            break
    return best


def _views(rows: DataFrame, folds: list[tuple[int, int]], width: int, classes: int) -> list[View]:
    """Means, deviations and class weights (as if all classes were as frequent) without the folds left out, from one row for each pair of folds and class."""
    finite = lambda i: F.when(~F.isnan(F.col("x")[i]) & (F.abs(F.col("x")[i]) < float("inf")), F.col("x")[i])
    parts = [e for i in range(width) for e in (F.count(finite(i)).alias(f"n{i}"), F.avg(finite(i)).alias(f"m{i}"), F.var_pop(finite(i)).alias(f"v{i}"))]
    label = F.col("y")[0].cast("int") if classes else F.lit(0)
    got = rows.filter("weight > 0").groupBy("fold", "inner", label.alias("label")).agg(F.count(F.lit(1)).alias("rows"), *parts).collect()  # folds and classes only
    out = []
    for outer, inner in folds:
        use = [r for r in got if r.fold != outer and r.inner != inner]
        n, m, v = (np.array([[r[f"{c}{i}"] or 0.0 for i in range(width)] for r in use], float).reshape(len(use), width) for c in "nmv")
        all_n = np.maximum(n.sum(axis=0), 1)
        mean = (n * m).sum(axis=0) / all_n
        deviation = np.sqrt((n * (v + (m - mean) ** 2)).sum(axis=0) / all_n)
        labels = np.bincount([r.label for r in use], [r.rows for r in use], max(classes, 1)) if use else np.zeros(max(classes, 1))
        balance = np.divide(labels.sum(), np.count_nonzero(labels) * labels, out=np.zeros(len(labels)), where=labels > 0) if classes else np.ones(1)
        out.append(View(outer, inner, mean, np.where(deviation > 1e-12, deviation, 1.0), balance))
    return out


def _decided(values: np.ndarray, classes: int) -> np.ndarray:
    """Outputs of rows, or the class of the largest one."""
    return values.argmax(axis=1)[:, None].astype(float) if classes else values


def _scores(rows: DataFrame, views: list[View], machines: list[Machine], weights: np.ndarray, grid: list, classes: int, n: int, gamma: float, seed: int) -> DataFrame:
    """(outer, inner, ordinal, score) of the inner folds: the mean squared error of all outputs, or one less the F1 of the classes, weighed by their rows."""
    outputs = len(machines) // (len(views) * len(grid))
    cube = weights.reshape(len(views), len(grid), outputs, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if len(b)):
            x, y = (_matrix(batch.column(c), len(batch)) for c in ("x", "y"))
            fold, inner = (np.asarray(batch.column(c)) for c in ("fold", "inner"))
            out = []
            for at, view in enumerate(views):
                keep = np.flatnonzero((fold != view.outer) & (inner == view.inner))
                z = seen(x[keep], view, n, gamma, seed) if len(keep) else None
                for j in range(len(grid) if len(keep) else 0):
                    guess = _decided(z @ cube[at, j].T, classes)
                    if classes:
                        pairs, times = np.unique(np.stack([y[keep, 0], guess[:, 0]], axis=1), axis=0, return_counts=True)
                        out += [(view.outer, view.inner, j, int(a), int(b), 0.0, int(c)) for (a, b), c in zip(pairs, times)]
                    else:
                        out.append((view.outer, view.inner, j, 0, 0, float(((guess - y[keep]) ** 2).sum()), y[keep].size))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names)

    names, by = ["outer", "inner", "ordinal", "y", "yhat", "squares", "n"], ["outer", "inner", "ordinal"]
    cells = rows.mapInArrow(run, "outer int, inner int, ordinal int, y int, yhat int, squares double, n long").groupBy(*names[:5]).agg(F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    if not classes:
        return cells.select(*by, (F.col("squares") / F.col("n")).alias("score"))
    both = cells.select(*by, "n", (F.col("y") == F.col("yhat")).alias("hit"), F.explode(F.array(F.struct(F.col("y").alias("k"), F.lit(True).alias("true")), F.struct(F.col("yhat").alias("k"), F.lit(False).alias("true")))).alias("s"))
    each = both.groupBy(*by, "s.k").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("s.true"), F.col("n")).otherwise(0)).alias("rows"), F.sum(F.when(F.col("hit") & F.col("s.true"), F.col("n")).otherwise(0)).alias("hits"))
    return each.groupBy(*by).agg((1 - F.sum(2 * F.col("hits") / F.col("all") * F.col("rows")) / F.sum("rows")).alias("score"))


def _cross_validated(df: DataFrame, folds: DataFrame, subject: list[str], keys: list[str], columns: list[str], y: list, grid: list[tuple[float, float | None]], classes: int, weight: str | None, inner: int, n: int, gamma: float, seed: int) -> DataFrame:
    x = df.join(folds, subject)
    if len(grid) > 1:
        x = x.join(group_folds(df, subject, inner).withColumnRenamed("fold", "inner"), subject)
    else:
        x = x.withColumn("inner", F.lit(-2))
    whole = [F.col(c).cast("double") for c in y]
    for c in whole:  # rows without a target are neither learned from nor predicted
        x = x.filter(c.isNotNull() & ~F.isnan(c))
    rows = settled(x.select(*keys, F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.array(*whole).alias("y"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("weight") if weight else F.lit(1.0).alias("weight"), "fold", "inner").repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, *keys))
    outer = sorted(r.fold for r in rows.select("fold").distinct().collect())
    outputs, data = classes or len(y), rows.select("x", "y", "weight", "fold", "inner")
    machines = lambda views, options: [Machine(v, k, *options[v][j]) for v in range(len(views)) for j in range(len(options[v])) for k in range(outputs)]
    best, score = {f: 0 for f in outer}, {}
    if len(grid) > 1 and outer:
        parts = sorted(r.inner for r in rows.select("inner").distinct().collect())
        views = _views(data, [(f, i) for f in outer for i in parts], len(columns), classes)
        tried = machines(views, [grid] * len(views))
        scores = _scores(data, views, tried, fitted(data, views, tried, n, gamma, seed), grid, classes, n, gamma, seed)
        means = scores.groupBy("outer", "ordinal").agg(F.avg("score").alias("score")).groupBy("outer").agg(F.min(F.struct("score", "ordinal")).alias("b"))
        chosen = means.select("outer", "b.*").collect()  # a row for each fold
        best |= {r.outer: r.ordinal for r in chosen}
        score = {r.outer: r.score for r in chosen}
    views = _views(data, [(f, -1) for f in outer], len(columns), classes)
    final = machines(views, [[grid[best[v.outer]]] for v in views])
    cube = fitted(data, views, final, n, gamma, seed).reshape(len(views), outputs, -1 if views else 1)
    place = {v.outer: i for i, v in enumerate(views)}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if len(b)):
            x, fold = _matrix(batch.column("x"), len(batch)), np.asarray(batch.column("fold"))
            out = np.zeros((len(batch), 1 if classes else outputs))
            for f in np.unique(fold):
                at = np.flatnonzero(fold == f)
                out[at] = _decided(seen(x[at], views[place[f]], n, gamma, seed) @ cube[place[f]].T, classes)
            guess = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), guess], [*kept, "yhat"])

    kept = [*keys, "y", "fold"]
    kind = rows.select(*kept, F.array().cast("array<double>").alias("yhat")).schema
    made = rows.select(*kept, "x").mapInArrow(predict, kind)
    pick = df.sparkSession.createDataFrame([(f, float(grid[best[f]][0]), grid[best[f]][1], score.get(f)) for f in outer], "fold int, c double, epsilon double, score double")
    return made.join(F.broadcast(pick), "fold")  # a row for each fold


def regression_cv(df: DataFrame, folds: DataFrame, subject: list[str], keys: list[str], columns: list[str], targets: list[str], grid: list[tuple[float, float]] = ((1.0, 0.1),), weight: str | None = None, inner: int = 3, n: int = 128, gamma: float = 0.0, seed: int = 42) -> DataFrame:
    """keys, fold, targets, yhat_<target>, c, epsilon, score: each row of df predicted by support vector regressions of the other folds (folds: subject, fold).

    Of several (c, epsilon) in grid each fold takes the one of the least mean squared error over inner folds of subjects of the others (ties: the first); its score is
    that error, null where there was no choice. Features are standardised on what is learned from, null and not-finite ones stand at the mean. Rows without a finite target
    are left out; rows whose weight is 0 or null are predicted but not learned from. No rows give no rows.
    """
    out = _cross_validated(df, folds, subject, keys, columns, list(targets), [tuple(g) for g in grid], 0, weight, inner, n, gamma, seed)
    return out.select(*keys, "fold", *(F.col("y")[i].alias(t) for i, t in enumerate(targets)), *(F.col("yhat")[i].alias(f"yhat_{t}") for i, t in enumerate(targets)), "c", "epsilon", "score")


def classification_cv(df: DataFrame, folds: DataFrame, subject: list[str], keys: list[str], columns: list[str], label: str, classes: int, grid: list[float] = (1.0,), inner: int = 3, n: int = 128, gamma: float = 0.0, seed: int = 42) -> DataFrame:
    """keys, fold, y, yhat, c, score: each row's class (0 .. classes - 1 in label; rows without are left out) by machines of the other folds, one for each class against the rest,
    classes weighing the same. The grid is of c; each fold takes the one of the best weighted F1 over inner folds (score: one less it). Else as regression_cv."""
    out = _cross_validated(df, folds, subject, keys, columns, [label], [(c, None) for c in grid], classes, None, inner, n, gamma, seed)
    return out.select(*keys, "fold", F.col("y")[0].cast("int").alias("y"), F.col("yhat")[0].cast("int").alias("yhat"), "c", "score")


class FourierMap(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """A stage of a pipeline, behind a scaler: outputCol is inputCol's random Fourier map (see fourier_map)."""

    n = Param(Params._dummy(), "n", "cosines", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "of the kernel; 0: one over the number of components", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="mapped", n=128, gamma=0.0, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="features", outputCol="mapped", n=128, gamma=0.0, seed=42)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n, gamma, seed = self.getOrDefault("n"), self.getOrDefault("gamma"), self.getSeed()

        @F.pandas_udf("array<double>")
        def cosines(x):
            import pandas as pd

            return pd.Series(list(fourier_map(np.stack(x.to_numpy()), n, gamma, seed)) if len(x) else [], dtype=object)

        return dataset.withColumn(self.getOutputCol(), array_to_vector(cosines(vector_to_array(self.getInputCol()))))


class _Machines(HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    c = Param(Params._dummy(), "c", "weight of the losses", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "errors up to it cost nothing (regression)", TypeConverters.toFloat)
    classes = Param(Params._dummy(), "classes", "number of classes; 0: regression", TypeConverters.toInt)


class KernelMachine(Estimator, _Machines):
    """Support vector regression (classes 0), or one machine for each class against the rest, on a vector column such as FourierMap's. Rows without a label are left out."""

    @keyword_only
    def __init__(self, featuresCol="mapped", labelCol="label", predictionCol="prediction", c=1.0, epsilon=0.1, classes=0):
        super().__init__()
        self._setDefault(featuresCol="mapped", labelCol="label", predictionCol="prediction", c=1.0, epsilon=0.1, classes=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KernelModel:
        label, classes = F.col(self.getLabelCol()).cast("double"), self.getOrDefault("classes")
        rows = dataset.filter(label.isNotNull() & ~F.isnan(label)).select(vector_to_array(self.getFeaturesCol()).alias("x"), F.array(label).alias("y"), F.lit(1.0).alias("weight"), F.lit(0).alias("fold"), F.lit(0).alias("inner"))
        rows, weights = settled(rows), []
        first = rows.select(F.size("x").alias("width")).first()
        if first:
            view = _views(rows, [(-1, -1)], first.width, classes)[0]
            view = view._replace(mean=np.zeros(first.width), scale=np.ones(first.width))
            epsilon = None if classes else self.getOrDefault("epsilon")
            weights = fitted(rows, [view], [Machine(0, k, self.getOrDefault("c"), epsilon) for k in range(classes or 1)]).ravel().tolist()
        return self._copyValues(KernelModel(coefficients=weights))


class KernelModel(Model, _Machines):
    coefficients = Param(Params._dummy(), "coefficients", "of all machines, one after the other, each with its constant last", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, coefficients=()):
        super().__init__()
        self._setDefault(featuresCol="mapped", labelCol="label", predictionCol="prediction", c=1.0, epsilon=0.1, classes=0)
        self._set(coefficients=list(coefficients))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes = self.getOrDefault("classes")
        weights = np.reshape(self.getOrDefault("coefficients"), (classes or 1, -1))

        @F.pandas_udf("double")
        def predict(x):
            import pandas as pd

            if not len(x) or not weights.size:
                return pd.Series(np.zeros(len(x)))
            return pd.Series(_decided(np.stack(x.to_numpy()) @ weights[:, :-1].T + weights[:, -1], classes)[:, 0])

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))
