"""Joint logistic fits and the permutation null against single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import attribution as at
from wayfare.operators import many_fits as mf
from wayfare.operators.features import feature_names


def newton(x, y, c=1.0):
    x = np.column_stack([x, np.ones(len(x))])
    n, p = len(y), y.sum()
    w = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    ridge = np.append(np.full(x.shape[1] - 1, 1 / (c * n)), 0)
    b = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x / n + np.diag(ridge), x.T @ (w * (q - y)) / n + ridge * b)
    return b


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_places_are_permuted(n):
    seen = [tuple(mf.permuted_places(np.arange(n), n, k).tolist()) for k in ("a", "b")]
    assert all(sorted(s) == list(range(n)) for s in seen)
    assert n < 5 or seen[0] != seen[1]
    part = np.arange(0, n, 3)
    assert mf.permuted_places(part, n, "a").tolist() == [seen[0][i] for i in part]


def test_permuted_labels_are_spread():
    y = mf.responses(np.arange(2000), 2000, 300, 7, 200)
    assert (y.sum(axis=0) == 300).all() and (y[:300, 0] == 1).all()
    share = y[:300, 1:].mean(axis=0)
    assert abs(share.mean() - 0.15) < 0.01 and share.std() < 0.04


def rows_of(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows, parts = [], []
    for g, n, d in (("A", 500, 3), ("B", 260, 2)):
        x = rng.normal(size=(n, d))
        y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 1)))).astype(int)
        order = np.argsort(-y, kind="stable")
        place = np.empty(n, int)
        place[order] = np.arange(n)
        rows += [(g, x[i].tolist(), int(place[i])) for i in range(n) if i % 4]
        parts.append((g, n, d, x, y, place))
    return spark.createDataFrame(rows, "group string, x array<double>, place long").repartition(5), parts


def test_joint_fits_are_single_fits(spark):
    rows, parts = rows_of(spark)
    fits = mf.fit_many(rows, {g: (n, int(y.sum())) for g, n, _, _, y, _ in parts}, {g: d for g, _, d, *_ in parts}, n_rounds=4, seed=11)
    for g, n, d, x, y, place in parts:
        drawn = mf.responses(place, n, int(y.sum()), 11, 4)
        assert (drawn[:, 0] == y).all()
        train = np.arange(n) % 4 > 0
        for r in range(5):
            assert fits.weights[g][r] == pytest.approx(newton(x[train], drawn[train, r]), abs=1e-6)
    assert fits.passes < 15


def test_one_class_is_an_error(spark):
    rows = spark.createDataFrame([("A", [1.0], 1), ("A", [2.0], 2)], "group string, x array<double>, place long")
    with pytest.raises(ValueError, match="one class only"):
        mf.fit_many(rows, {"A": (3, 1)}, {"A": 1}, n_rounds=0, seed=1)


def test_linear_null_equals_single_fits(spark):
    rng = np.random.default_rng(8)
    names = sorted({c for s in ("S1", "S2") for c in feature_names(s)})
    rows, data = [], {}
    for stage in ("S1", "S2"):
        x = rng.normal(size=(240, len(names)))
        y = rng.random(240) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1])))
        data[stage] = (x, y)
        rows += [(f"s{i}", stage, bool(y[i]), *map(float, x[i])) for i in range(240)]
    features = spark.createDataFrame(rows, "session_id string, stage string, label boolean, " + ", ".join(f"{c} double" for c in names))
    part = ["train" if i % 3 else "val" for i in range(240)]
    split = spark.createDataFrame([(f"s{i}", p) for i, p in enumerate(part)], "session_id string, partition string")
    observed, nulls = at.permutation_null(features, split, n_rounds=2, seed=5, model="logreg", stages=("S1", "S2"))
    places = mf.with_places(features.withColumn("y", F.col("label").cast("int")), ["stage"])
    place = {(r["stage"], r["session_id"]): r["place"] for r in places.collect()}
    train = np.array([p == "train" for p in part])
    got = {(r["round"], r["stage"], r["group"]): r["share"] for r in nulls.collect()}
    got |= {(-1, r["stage"], r["group"]): r["share"] for r in observed.collect()}
    want = {}
    for stage, (x, y) in data.items():
        use = [names.index(c) for c in feature_names(stage)]
        z = x[:, use]
        z = (z - z[train].mean(axis=0)) / z[train].std(axis=0)
        drawn = mf.responses(np.array([place[stage, f"s{i}"] for i in range(240)]), 240, int(y.sum()), 5, 2)
        for r in range(3):
            w = newton(z[train], drawn[train, r])[:-1]
            size = np.abs(w) * np.abs(z[~train] - z[train].mean(axis=0)).mean(axis=0)
            total = sum(s for c, s in zip(feature_names(stage), size) if c in feature_names("S1"))
            want |= {(r - 1, stage, c): s / total for c, s in zip(feature_names(stage), size) if c in feature_names("S1")}
    assert got == pytest.approx(want, abs=1e-6)
