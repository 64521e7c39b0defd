"""Folds dealt in bulk against a deal of one subject at a time."""

import random

import pytest

from tidewave.operators import folds


def plain(sizes, k):
    """Largest first, then by name, into the lightest fold, the first of equal ones."""
    load, out = [0] * k, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        out[name] = load.index(min(load))
        load[out[name]] += n
    return out


def test_turns_equal_single_deals():
    r = random.Random(1)
    for _ in range(400):
        k, size, count = r.randint(1, 6), r.randint(1, 9), r.randint(1, 40)
        load = [r.randint(0, 30) for _ in range(k)]
        turns, after = folds._turns(load, size, count)
        dealt, one = [], list(load)
        for _ in range(count):
            dealt.append(one.index(min(one)))
            one[dealt[-1]] += size
        starts = [s for s, _ in turns]
        got = [next(f[(j - s) % len(f)] for s, f in reversed(turns) if s <= j) for j in range(count)]
        assert got == dealt and after == one and starts == sorted(starts)


@pytest.mark.parametrize("k", [2, 5])
def test_folds_equal_single_deals(spark, k):
    """Many subjects of few sizes, over several ranges."""
    r = random.Random(k)
    sizes = {f"s{i:03}": r.choice([1, 1, 1, 2, 2, 7, r.randint(3, 40)]) for i in range(150)}
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i int").repartition(4)
    assert {r.s: r.fold for r in folds.group_folds(df, ["s"], k).collect()} == plain(sizes, k)
    alone = {r.s: r.fold for r in folds.group_folds(df, ["s"], k, "leave_one_out").collect()}
    assert [s for s, _ in sorted(alone.items(), key=lambda x: x[1])] == sorted(sizes, key=lambda s: (-sizes[s], s)) and set(alone.values()) == set(range(150))
    assert folds.group_folds(df.limit(0), ["s"], k).count() == 0


def test_boosted_models_learn_from_everything(spark, monkeypatch):
    """All rows and columns for each tree, and as many rounds as the operator has, in the query too."""
    import tidewave.queries as registered

    made = []
    monkeypatch.setattr(registered.models, "cross_validated", lambda data, folds, by, make, keep: made.append(make()) or data.select(*keep))
    registered.QUERIES["boosted_regression_folds"](spark, "/root/testdata/sf0.001")
    for model in (made[0], registered.models.boosted_regressor(["a"], "y")):
        trees = model.getStages()[-1]
        assert (trees.getSubsamplingRate(), trees.getFeatureSubsetStrategy(), trees.getMaxIter(), trees.getMaxDepth()) == (1.0, "all", 200, 6)
