"""Estimators over feature tables by MLlib, and cross-validated predictions.

Support vector machines with a radial kernel are random Fourier maps under the machines of kernel.py; boosted trees are MLlib's.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from tidewave.functions.tables import settled
from tidewave.operators.kernel import FourierMap, KernelMachine
from tidewave.operators.metrics import class_weights

#: Models that are fitted at the same time: the many small steps of a boosted one leave most of a cluster idle.
FITS = 3


def assembled(columns: list[str]) -> list:
    return [Imputer(inputCols=columns, outputCols=columns), VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def fourier(df: DataFrame, columns: list[str], n: int = 128, gamma: float | None = None, seed: int = 0) -> DataFrame:
    """df with rff_0 .. rff_{n-1}: cosines of random projections, whose products approximate exp(-gamma * distance^2) of standardised columns."""
    gamma = gamma or 1.0 / len(columns)
    random = np.random.default_rng(seed)
    w, b = random.normal(scale=math.sqrt(2 * gamma), size=(n, len(columns))), random.uniform(0, 2 * math.pi, n)
    scale = math.sqrt(2.0 / n)
    return df.select("*", *((F.lit(scale) * F.cos(sum((F.col(c) * float(w[k, j]) for j, c in enumerate(columns)), F.lit(float(b[k]))))).alias(f"rff_{k}") for k in range(n)))


def forest_classifier(columns: list[str], label: str, trees: int = 200, seed: int = 42, weight: str | None = None) -> Pipeline:
    more = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[*assembled(columns), RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=30, seed=seed, **more)])


def svm_classifier(columns: list[str], label: str, weight: str | None = None) -> Pipeline:
    """One linear machine against the rest for each class."""
    more = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[*assembled(columns), OneVsRest(classifier=LinearSVC(maxIter=50), labelCol=label, featuresCol="features", **more)])


def kernel_classifier(columns: list[str], label: str, classes: int, c: float = 1.0, n: int = 128, gamma: float = 0.0, seed: int = 42) -> Pipeline:
    """Support vector classes with a radial kernel on standardised columns, classes weighing the same; the fitted pipeline is saved and loaded whole."""
    return Pipeline(stages=[*assembled(columns), FourierMap(n=n, gamma=gamma, seed=seed), KernelMachine(labelCol=label, c=c, classes=classes)])


def kernel_regressor(columns: list[str], label: str, c: float = 1.0, epsilon: float = 0.1, n: int = 128, gamma: float = 0.0, seed: int = 42) -> Pipeline:
    """Support vector regression with a radial kernel on standardised columns."""
    return Pipeline(stages=[*assembled(columns), FourierMap(n=n, gamma=gamma, seed=seed), KernelMachine(labelCol=label, c=c, epsilon=epsilon)])


def boosted_regressor(columns: list[str], label: str, rounds: int = 200, seed: int = 42, weight: str | None = None) -> Pipeline:
    """Every tree learns from all rows and all columns."""
    more = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[*assembled(columns), GBTRegressor(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=6, stepSize=0.05, subsamplingRate=1.0, featureSubsetStrategy="all", seed=seed, **more)])


def huber_regressor(columns: list[str], label: str, weight: str | None = None) -> Pipeline:
    more = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[*assembled(columns), LinearRegression(labelCol=label, featuresCol="features", loss="huber", maxIter=50, **more)])


def balanced(df: DataFrame, label: str, classes: int) -> DataFrame:
    """df with weight, so that every class present weighs as much."""
    return df.join(F.broadcast(class_weights(df, label, classes)), label)  # a row for each class


def train_rows(df: DataFrame, mode: str = "all", nonfixation: float = 0.2) -> DataFrame:
    """df with weight: all rows, fixation rows only, or all with the others weighing less."""
    if mode not in ("all", "fixation", "weighted"):
        raise ValueError(f"unknown training windows {mode}")
    x = df.filter("is_fixation") if mode == "fixation" else df
    return x.withColumn("weight", F.when(F.lit(mode != "weighted") | F.col("is_fixation"), 1.0).otherwise(nonfixation))


def cross_validated(df: DataFrame, folds: DataFrame, subject: list[str], make: Callable[[], Pipeline], prepare: Callable[[DataFrame], DataFrame] = lambda x: x, keep: list[str] | None = None) -> DataFrame:
    """keep, fold, yhat: each row predicted by a model of the other folds. The loop is over folds only, FITS at a time; fits and predictions are distributed."""
    x = settled(df.join(folds, subject))  # each fit reads it many times
    every, out = [f for (f,) in folds.select("fold").distinct().orderBy("fold").collect()], None
    fit = inheritable_thread_target(df.sparkSession)(lambda fold: make().fit(prepare(x.filter(F.col("fold") != fold))))
    with ThreadPool(FITS) as pool:
        models = pool.map(fit, every, 1)
    for fold, model in zip(every, models):
        y = model.transform(x.filter(F.col("fold") == fold)).select(*(keep or df.columns), "fold", F.col("prediction").alias("yhat"))
        out = y if out is None else out.unionByName(y)
    return out
