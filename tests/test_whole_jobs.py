"""Registered queries run their operators at full size: default trees, all seeds, stages and trials."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from wayfare.operators import models
from wayfare.operators.stages import MODEL_STAGES
from wayfare.plans import attribution_queries as aq
from wayfare.plans import model_queries as mq
from wayfare.plans.artefacts import SEEDS
from wayfare.plans.registry import QUERIES


def artefacts(**parts):
    spark = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="whole-jobs"))
    return SimpleNamespace(spark=spark, folder="none", table=lambda name, build: None, **parts)


def function_of(name):
    """The registered query as a function of its artefacts."""
    return next(c.cell_contents for c in QUERIES[name].__closure__ if callable(c.cell_contents))


def test_static_runs_boost_at_full_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mq, "_RUNS", {})
    monkeypatch.setattr(mq, "_merge", lambda parts: parts, raising=False)
    monkeypatch.setattr(mq.runs, "run_static_models", lambda table, **options: seen.append(options))
    mq._static_runs(artefacts())
    assert {m for o in seen for m in o["models"]} == {"logreg", "gbt"}
    for options in seen:
        assert tuple(options["seeds"]) == SEEDS
        trees = models.build_model("gbt", seed=1, params=options.get("params"))
        assert (trees.getMaxIter(), trees.getMaxDepth()) == (200, 6)


def test_fit_models_takes_the_default_trees(spark, monkeypatch):
    class Fitted:
        def score(self, rows):
            return rows

    seen = []

    def fit(train, kind, columns, *, seed, params=None):
        seen.append(models.build_model(kind, seed=seed, params=params))
        return Fitted()

    rows = spark.createDataFrame([("a", "S1", "train", 1, 0.5, True)], "session_id string, stage string, partition string, y int, score double, label boolean")
    monkeypatch.setattr(mq.models, "fit_model", fit)
    parts = artefacts(features=rows.drop("partition"), split=rows.select("session_id", "partition"))
    parts.spark = spark
    function_of("fit_models")(parts)
    forests = [m for m in seen if hasattr(m, "getNumTrees")]
    boosted = [m for m in seen if hasattr(m, "getStepSize")]
    assert len(seen) == 9 and len(forests) == len(boosted) == 3
    assert {(m.getNumTrees(), m.getMaxDepth()) for m in forests} == {(500, 30)}
    assert {(m.getMaxIter(), m.getMaxDepth()) for m in boosted} == {(200, 6)}


def test_tune_runs_every_trial_of_every_stage(spark, monkeypatch):
    columns = "session_id string, stage string, partition string, label boolean"
    rows = spark.createDataFrame([(f"{p}{s}", s, p, True) for s in MODEL_STAGES for p in ("train", "val")], columns)
    monkeypatch.setattr(mq.models, "draw_params", lambda space, rng: {"C": 1.0})
    monkeypatch.setattr(mq.models, "preprocess", lambda *_, **__: SimpleNamespace(transform=lambda df: df.withColumn("features", F.lit(0))), raising=False)
    monkeypatch.setattr(mq.models, "balanced", lambda df, *_, **__: (df, None))
    monkeypatch.setattr(mq.models, "fitted_on", lambda *_: None)
    monkeypatch.setattr(mq.models, "fit_model", lambda *_, **__: SimpleNamespace(score=lambda df: df.select("y", F.lit(0.5).alias("score"))))
    monkeypatch.setattr(mq.models, "_pr_aucs", lambda held, fitted: {i: 0.5 for i in fitted}, raising=False)
    parts = artefacts(features=rows.drop("partition"), split=rows.select("session_id", "partition"))
    parts.spark, parts.table = spark, lambda name, build: build()
    found = mq._trials(parts).groupBy("study").count().collect()
    assert {tuple(r) for r in found} == {(f"{s}_logreg_seed42", 100) for s in MODEL_STAGES}


def test_seed_consistency_compares_all_seeds_at_full_size(spark, monkeypatch):
    seen = []

    def explain(features, split, *, model, seed, params=None):
        seen.append((seed, models.build_model(model, seed=seed, params=params)))
        rows = [("S1", seed, f"s{i}", f, float(i * (k + 1) % 5), 0.1 * (k + 1) * i) for i in range(6) for k, f in enumerate(("n_events", "price_mean"))]
        table = spark.createDataFrame(rows, "stage string, seed int, session_id string, feature string, value double, shap double")
        return {"S1": SimpleNamespace(long=lambda: table)}

    monkeypatch.setattr(aq, "_EXPLAINED", {})
    monkeypatch.setattr(aq.at, "explain_stages", explain)
    parts = artefacts(features=spark.range(1), split=None)
    parts.spark = spark
    found = function_of("seed_consistency")(parts).collect()
    assert [(r["stage"], r["n_pairs"]) for r in found] == [("S1", 10)]
    assert {s for s, _ in seen} == set(SEEDS)
    assert {(m.getMaxIter(), m.getMaxDepth()) for _, m in seen} == {(200, 6)}
