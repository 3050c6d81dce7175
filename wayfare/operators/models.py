"""Classifiers on ``pyspark.ml`` with seeds, class weights and a fixed search space."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, new_path
from .metrics import ranking_metrics, threshold_counts
from .preprocess import Preprocessor, preprocess, smote_oversample, with_class_weight

#: The three boosting libraries of common use are one family here.
BOOSTED = ("gbt", "lightgbm", "xgboost", "catboost")
MODELS = ("logreg", "random_forest", *BOOSTED)
NEEDS_SCALING = ("logreg",)
IMBALANCE = ("class_weight", "smote", "none")
#: Rows for which a boosting fit takes a task; a small table in many tasks spends its time on starting them.
BOOSTED_ROWS = 1 << 13
#: Fits that run beside each other, on tables of up to so many rows; each keeps its own copy, so larger ones wait for each other.
POOL, POOLED_ROWS = 6, 1 << 21
#: Trials of a search that are scored in one pass.
TRIALS = 12


class ModelError(ValueError):
    """A model cannot be built as asked."""


def build_model(model_type: str, *, seed: int, params: dict | None = None, weight: str | None = None, n_rows: int = 1):
    """An unfitted classifier. ``C`` is the usual inverse strength of the penalty."""
    p = dict(params or {})
    if model_type == "logreg":
        model = LogisticRegression(
            maxIter=p.pop("max_iter", 200), regParam=1.0 / (p.pop("C", 1.0) * max(n_rows, 1)),
            standardization=False)
    elif model_type == "random_forest":
        model = RandomForestClassifier(
            numTrees=p.pop("n_estimators", 500), maxDepth=p.pop("max_depth", 30),
            minInstancesPerNode=p.pop("min_samples_leaf", 5), seed=seed,
            featureSubsetStrategy=str(p.pop("max_features", "auto")))
    elif model_type in BOOSTED:
        model = GBTClassifier(
            maxIter=p.pop("n_estimators", p.pop("iterations", 200)), stepSize=p.pop("learning_rate", 0.05),
            maxDepth=p.pop("max_depth", p.pop("depth", 6)), subsamplingRate=p.pop("subsample", 0.9),
            featureSubsetStrategy=str(p.pop("colsample_bytree", 0.9)), seed=seed,
            minInstancesPerNode=p.pop("min_child_samples", 1))
    else:
        raise ModelError(f"unknown model type {model_type!r}; known: {MODELS}")
    if p:
        raise ModelError(f"unknown parameters for {model_type}: {sorted(p)}")
    model = model.setFeaturesCol("features").setLabelCol("y")
    return model.setWeightCol(weight) if weight else model


def fitted_on(estimator: Estimator, rows: DataFrame, n_rows: int) -> Model:
    """The fitted model without its training summary.

    A summary holds the session, which would travel with every scoring task and cannot once the session has a job tag.
    Boosting cuts its lineage every ten rounds, for which the context needs a folder.
    """
    spark = rows.sparkSession
    if isinstance(estimator, GBTClassifier):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(new_path(spark, "rounds"))
        rows = rows.coalesce(1 + n_rows // BOOSTED_ROWS)
    model = estimator.fit(rows)
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(spark._jvm.scala.Option.empty())
    return model


def beside(spark: SparkSession, work: Callable, tasks: Sequence, n_rows: int) -> list:
    """``work`` of every task, ``POOL`` beside each other on tables of up to ``POOLED_ROWS`` rows."""
    with ThreadPoolExecutor(POOL if n_rows <= POOLED_ROWS else 1) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), tasks))


@dataclass
class FittedModel:
    """Preprocessing and estimator fitted on the same rows."""

    kind: str
    preprocessor: Preprocessor
    estimator: Model
    params: dict = field(default_factory=dict)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        scored = self.estimator.transform(self.preprocessor.transform(df))
        return scored.withColumn(name, vector_to_array("probability")[1]).drop(
            "features", "probability", "rawPrediction", "prediction")

    def score_matrix(self, df: DataFrame, column: str = "x", name: str = "prediction_score") -> DataFrame:
        """Score rows that are already in model space, held as an array column."""
        vector = df.withColumn("features", array_to_vector(column))
        return self.estimator.transform(vector).withColumn(name, vector_to_array("probability")[1]).drop(
            "features", "probability", "rawPrediction", "prediction")


def balanced(rows: DataFrame, imbalance: str, *, key: str = "session_id", seed: int = 42) -> tuple[DataFrame, str | None]:
    """Prepared train rows (``key, y, features``) against an imbalance, and the name of their weight."""
    if imbalance not in IMBALANCE:
        raise ModelError(f"unknown imbalance method {imbalance!r}")
    if imbalance == "class_weight":
        return with_class_weight(rows), "weight"
    if imbalance == "smote":
        return smote_oversample(rows, key=key, seed=seed).withColumn("features", array_to_vector("features")), None
    return rows, None


def fit_model(
    train: DataFrame, model_type: str, numeric: Sequence[str], categorical: Sequence[str] = (), *, seed: int,
    params: dict | None = None, imbalance: str = "class_weight", key: str = "session_id",
) -> FittedModel:
    """Fit preprocessing and classifier on ``train`` (label ``y``)."""
    if imbalance not in IMBALANCE:
        raise ModelError(f"unknown imbalance method {imbalance!r}")
    prepared = preprocess(train, numeric, categorical, scale=model_type in NEEDS_SCALING)
    rows, weight = balanced(prepared.transform(train).select(key, "y", "features"), imbalance, key=key, seed=seed)
    rows = rows.persist()
    try:
        n = rows.count()
        fitted = fitted_on(build_model(model_type, seed=seed, params=params, weight=weight, n_rows=n), rows, n)
    finally:
        rows.unpersist()
    return FittedModel(model_type, prepared, fitted, dict(params or {}))


# Search ranges as (kind, low, high[, step]) in the names build_model takes.
SEARCH_SPACES = {
    "gbt": {
        "n_estimators": ("int", 200, 1200, 100),
        "learning_rate": ("log", 0.01, 0.2),
        "max_depth": ("int", 3, 12, 1),
        "min_child_samples": ("logint", 5, 200),
        "subsample": ("float", 0.6, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0),
    },
    "random_forest": {
        "n_estimators": ("int", 200, 1000, 100),
        "max_depth": ("int", 4, 30, 1),
        "min_samples_leaf": ("logint", 1, 50),
        "max_features": ("float", 0.2, 1.0),
    },
    "logreg": {"C": ("log", 1e-3, 1e2)},
}


def draw_params(space: dict, rng: random.Random) -> dict:
    out = {}
    for name, (kind, low, high, *step) in space.items():
        if kind == "int":
            out[name] = rng.randrange(low, high + 1, step[0])
        elif kind == "float":
            out[name] = rng.uniform(low, high)
        else:
            value = math.exp(rng.uniform(math.log(low), math.log(high)))
            out[name] = int(round(value)) if kind == "logint" else value
    return out


def _pr_aucs(rows: DataFrame, fitted: dict[int, Model]) -> dict[int, float]:
    """PR-AUC of every model over rows in model space, in one pass."""
    wide, cells = rows, []
    for i, model in fitted.items():
        model.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_q{i}")
        wide = model.transform(wide)
        cells.append(F.struct(F.lit(i).alias("trial"), vector_to_array(f"_p{i}")[1].alias("score")))
    scored = wide.select("y", F.explode(F.array(*cells)).alias("c")).select("c.*", "y")
    found = ranking_metrics(threshold_counts(scored, ["trial"]), ["trial"])
    return {r["trial"]: r["pr_auc"] for r in found.select("trial", "pr_auc").collect()}  # one row per trial


def tune(
    train: DataFrame, val: DataFrame, model_type: str, columns: Sequence[str], *, stage: str = "static",
    n_trials: int = 100, seed: int = 42, imbalance: str = "class_weight", space: dict | None = None,
    path: str | None = None,
) -> DataFrame:
    """Seeded random search maximising validation PR-AUC; one row per trial.

    Preprocessing does not depend on the parameters and happens once. Trials are fitted beside each other and scored
    ``TRIALS`` in a pass. With ``path`` they are appended as they are scored, and finished trials of the same study are
    not run again.
    """
    kind = "gbt" if model_type in BOOSTED else model_type
    if space is None and kind not in SEARCH_SPACES:
        raise ModelError(f"no search space for {model_type!r}")
    spark, rng = train.sparkSession, random.Random(f"{stage}|{kind}|{seed}")
    schema = "study string, trial int, params string, value double"
    study = f"{stage}_{model_type}_seed{seed}"
    done: dict[int, tuple] = {}
    if path:
        try:
            found = spark.read.schema(schema).parquet(path).where(F.col("study") == study)
            done = {r["trial"]: tuple(r) for r in found.collect()}  # one row per trial
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    drawn = [draw_params(space or SEARCH_SPACES[kind], rng) for _ in range(n_trials)]
    left = [i for i in range(n_trials) if i not in done]
    if left:
        prepared = preprocess(train, columns, scale=model_type in NEEDS_SCALING)
        rows, weight = balanced(prepared.transform(train).select("session_id", "y", "features"), imbalance, seed=seed)
        rows = materialise(rows, "tuned_on")
        n = rows.count()
        # the fits read it again and again
        rows = rows.coalesce(1 + n // BOOSTED_ROWS).persist()
        held = materialise(prepared.transform(val).select("y", "features"), "tuned_for")

        def fit(i):
            return fitted_on(build_model(model_type, seed=seed, params=drawn[i], weight=weight, n_rows=n), rows, n)

        try:
            for at in range(0, len(left), TRIALS):
                some = left[at:at + TRIALS]
                values = _pr_aucs(held, dict(zip(some, beside(spark, fit, some, n))))
                found = [(study, i, json.dumps(drawn[i], sort_keys=True), values.get(i)) for i in some]
                done.update((r[1], r) for r in found)
                if path:
                    spark.createDataFrame(found, schema).coalesce(1).write.mode("append").parquet(path)
        finally:
            rows.unpersist()
    return spark.createDataFrame([done[i] for i in sorted(done)], schema)


def load_tuned(trials: DataFrame, study: str) -> dict:
    """Best parameters of a finished study; the earliest trial wins ties."""
    best = trials.where(F.col("study") == study).agg(
        F.max(F.struct("value", (-F.col("trial")).alias("t"), "params")).alias("b")).first()["b"]
    if best is None:
        raise FileNotFoundError(f"no trials of {study!r}")
    return json.loads(best["params"])


def load_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("study string, trial int, params string, value double").parquet(path)
