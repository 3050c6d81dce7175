"""Model runs over stages, sets and seeds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import calibration, decisions, metrics, models
from wayfare.operators.features import feature_names
from wayfare.operators.splits import stratified_slice
from wayfare.plans import runs

SEEDS, SETS = (42, 43), ("baseline", "full")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    names = sorted({c for s in ("S1", "S2") for c in feature_names(s)})
    rows = []
    for stage in ("S1", "S2"):
        for i in range(400):
            x = rng.normal(size=len(names))
            label = bool(rng.random() < 1 / (1 + np.exp(-(x[:3].sum() - 0.5))))
            rows.append((f"s{i}", stage, label, *[float(v) if rng.random() > 0.02 else None for v in x]))
    columns = ", ".join(f"{c} double" for c in names)
    features = spark.createDataFrame(rows, f"session_id string, stage string, label boolean, {columns}")
    split = spark.createDataFrame(
        [(f"s{i}", "train" if i < 240 else "val" if i < 320 else "test") for i in range(400)], "session_id string, partition string")
    return features, split


@pytest.fixture(scope="module")
def found(table):
    features, split = table
    return runs.run_stage_models(features, split, stages=("S1", "S2"), models=("logreg",), seeds=SEEDS, feature_sets=SETS)


def test_every_run_has_its_rows(found):
    keys = [tuple(r) for r in found.results.select(*runs.KEYS).collect()]
    assert sorted(keys) == sorted((s, "logreg", n, k) for s in ("S1", "S2") for n in SETS for k in SEEDS)
    sizes = {tuple(r)[:5]: r["count"] for r in found.scores.groupBy(*runs.KEYS, "partition").count().collect()}
    assert {k[4]: n for k, n in sizes.items()} == {"train": 240, "val": 80, "test": 80} and len(sizes) == 24


def test_scores_are_those_of_single_fits(table, found):
    features, split = table
    rows = features.where("stage = 'S1'").join(split, "session_id").withColumn("y", F.col("label").cast("int"))
    train = rows.where("partition = 'train'")
    held = stratified_slice(train.select("session_id", "y"), 0.2, label="y").where("in_slice").select("session_id")
    fitted = models.fit_model(train.join(held, "session_id", "left_anti"), "logreg", feature_names("S1", "baseline"), seed=42)
    want = {r[0]: r[1] for r in fitted.score(rows).select("session_id", "score").collect()}
    own = found.scores.where("stage = 'S1' and feature_set = 'baseline'")
    for seed in SEEDS:
        got = {r[0]: r[1] for r in own.where(F.col("seed") == seed).select("session_id", "raw_score").collect()}
        assert got == pytest.approx(want, abs=1e-6)
    kept = own.where("seed = 42").join(held, "session_id").select("y", F.col("raw_score").alias("score"))
    mean = kept.agg(F.avg("y")).first()[0]
    result = found.results.where("stage = 'S1' and feature_set = 'baseline' and seed = 42").first()
    assert result["prior_calibration"] == pytest.approx(mean)
    alone = calibration.calibrate_isotonic(kept).transform(own.where("seed = 42").select("session_id", "score", F.col("raw_score").alias("r")).withColumn("was", F.col("score")).withColumn("score", F.col("r")))
    assert all(abs(r["calibrated"] - r["was"]) < 1e-9 for r in alone.collect())


def test_static_results_and_boosted_seeds(spark):
    rng = np.random.default_rng(1)
    from wayfare.sources.schema import STATIC_CATEGORICAL, STATIC_NUMERIC

    rows = []
    for i in range(300):
        x = rng.normal(size=len(STATIC_NUMERIC))
        rows.append((f"o{i}", bool(rng.random() < 1 / (1 + np.exp(-2 * x[0]))), "train" if i < 180 else "val" if i < 240 else "test",
                     *map(float, x), *[str(rng.integers(3)) for _ in STATIC_CATEGORICAL]))
    columns = ", ".join([f"`{c}` double" for c in STATIC_NUMERIC] + [f"`{c}` string" for c in STATIC_CATEGORICAL])
    table = spark.createDataFrame(rows, f"session_id string, label boolean, partition string, {columns}")
    found = runs.run_static_models(
        table, models=("gbt",), seeds=(1, 2), params={"n_estimators": 2, "max_depth": 2, "subsample": 0.5}, calibrate="sigmoid")
    got = runs.static_results(found).collect()
    assert {r["seed"] for r in got} == {1, 2}
    assert all(0 <= r["brier_prior_corrected"] <= 1 and r["roc_auc"] > 0.6 for r in got)


def test_sigmoid_of_several_runs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for run, (a, b) in {"x": (3.0, -1.0), "y": (-2.0, 0.5)}.items():
        for s in np.round(rng.normal(size=800), 2).tolist():
            rows.append((run, s, int(rng.random() < 1 / (1 + np.exp(-(a * s + b))))))
    rows += [("one", 0.5, 1), ("one", 0.7, 1)]
    df = spark.createDataFrame(rows, "run string, score double, y int")
    fit = calibration.calibrate_sigmoid(df, ["run"])
    got = {(r["run"], r["score"]): r["calibrated"] for r in fit.transform(df).collect()}
    for run in ("x", "y"):
        s, y = np.array([r[1] for r in rows if r[0] == run]), np.array([r[2] for r in rows if r[0] == run])
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(w[0] * s + w[1])))
            x = np.column_stack([s, np.ones_like(s)])
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - y))
        assert [got[run, v] for v in s[:50]] == pytest.approx((1 / (1 + np.exp(-(w[0] * s[:50] + w[1])))).tolist(), abs=1e-6)
    assert got["one", 0.5] > 0.99


def test_headline_runs_have_intervals(found):
    for r in found.results.collect():
        for m in metrics.INTERVAL_METRICS:
            low, high = r[f"{m}_ci_low"], r[f"{m}_ci_high"]
            if r["feature_set"] == "full":
                assert low <= r[m] <= high and low < high, (r["stage"], r["seed"], m)
            else:
                assert low is None and high is None
    table = decisions.stage_performance(found.results)
    means = {r["stage"]: r for r in table.collect()}
    assert {"pr_auc_ci_low", "pr_auc_ci_high", "roc_auc_ci_low", "roc_auc_ci_high"} <= set(table.columns)
    assert all(r["pr_auc_ci_low"] < r["pr_auc"] < r["pr_auc_ci_high"] for r in means.values()) and set(means) == {"S1", "S2"}
