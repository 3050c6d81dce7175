"""Model runs: fit, calibrate, choose a threshold, score, over stages and seeds.

Only the fits are jobs of their own, a bounded number at a time; what comes before is shared
and what comes after is done for all runs in one pass. Rows never pass through the driver.
All scores end up in one written long table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.calibration import CALIBRATIONS, estimate_prior_em
from ..operators.features import feature_names
from ..operators.metrics import classification_report, select_threshold, threshold_counts
from ..operators.models import NEEDS_SCALING, balanced, beside, build_model, fitted_on
from ..operators.preprocess import preprocess
from ..operators.resampling import MIN_RESAMPLES, bootstrap_multi
from ..operators.splits import common_cohort, stratified_slice
from ..operators.stages import MODEL_STAGES
from ..session import materialise
from ..sources.schema import STATIC_CATEGORICAL, STATIC_NUMERIC

KEYS = ["stage", "model", "feature_set", "seed"]


@dataclass
class Runs:
    """``scores``: (run, partition, session_id, y, score, raw_score); ``results``: one row per run."""

    scores: DataFrame
    thresholds: DataFrame
    results: DataFrame


@dataclass
class _Ready:
    """Rows of one stage and feature set in model space, written once for all their runs."""

    rows: DataFrame
    trained_on: DataFrame
    weight: str | None
    n_rows: int


def _ready(rows, numeric, categorical, *, scale, imbalance, seed, fit_on, calibrate_on) -> _Ready:
    prepared = preprocess(rows.where(fit_on), numeric, categorical, scale=scale)
    table = materialise(prepared.transform(rows).select(
        "session_id", "partition", "y", fit_on.alias("_fit"), calibrate_on.alias("_c"), "features"), "ready")
    train, weight = balanced(table.where("_fit").select("session_id", "y", "features"), imbalance, seed=seed)
    if imbalance == "smote":
        train = materialise(train, "oversampled")
    return _Ready(table, train, weight, train.count())


def _scored(ready: _Ready, runs: list[tuple[tuple, object]]) -> DataFrame:
    """The raw scores of all runs over one set of prepared rows: one pass, one row per run and session."""
    wide, columns = ready.rows, []
    for i, (_, model) in enumerate(runs):
        model.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_q{i}")
        wide = model.transform(wide)
        columns.append(vector_to_array(f"_p{i}")[1])
    cells = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(KEYS, run)], c.alias("raw_score"))
                      for (run, _), c in zip(runs, columns)])
    return wide.select(F.explode(cells).alias("c"), "partition", "session_id", "y", "_c").select("c.*", "partition", "session_id", "y", "_c")


@dataclass
class Job:
    """Rows of one stage and feature set, with the models and seeds to fit on them."""

    rows: DataFrame
    stage: str
    feature_set: str
    numeric: list[str]
    categorical: list[str]
    fit_on: Column
    calibrate_on: Column
    params: dict[str, dict] | dict | None = None


def _run_jobs(jobs: list[Job], models, seeds, *, imbalance, calibrate, evaluate=None, intervals_for=("full",),
              n_resamples=MIN_RESAMPLES) -> Runs:
    """All runs of all jobs.

    Runs on the feature sets in ``intervals_for`` get bootstrap intervals of their test metrics, all from one set of
    passes; the other sets are compared over seeds.

    Preprocessing happens once per stage, set and scaling; fits run beside each other, ``POOL`` at a time, so that small
    ones do not wait for each other's single tasks; a model without randomness is fitted once for all seeds. Scores, calibration,
    thresholds, metrics and priors are each one pass for all runs together.
    """
    if calibrate != "none" and calibrate not in CALIBRATIONS:
        raise ValueError(f"unknown calibration {calibrate!r}")

    def prepare(task):
        job, scale, seed = task
        return _ready(job.rows, job.numeric, job.categorical, scale=scale, imbalance=imbalance, seed=seed,
                      fit_on=job.fit_on, calibrate_on=job.calibrate_on)

    def fit(task):
        ready, model, seed, params = task
        built = build_model(model, seed=seed, params=params, weight=ready.weight, n_rows=ready.n_rows)
        return fitted_on(built, ready.trained_on, ready.n_rows)

    def spot(j, model, seed):
        """Which prepared rows a run uses: drawn rows differ by seed."""
        return (j, model in NEEDS_SCALING, seed if imbalance == "smote" else seeds[0])

    spots = sorted({spot(j, m, s) for j in range(len(jobs)) for m in models for s in seeds})
    fits = [(k, m, s) for k in spots for m in models for s in seeds if spot(k[0], m, s) == k]
    # Linear fits hold no randomness: their first seed stands for all that share the rows.
    first = {(k, m, s): (k, m, next(t for t in seeds if spot(k[0], m, t) == k) if m == "logreg" else s) for k, m, s in fits}
    spark = jobs[0].rows.sparkSession
    ready = dict(zip(spots, beside(spark, prepare, [(jobs[j], scale, seed) for j, scale, seed in spots], 0)))
    distinct = list(dict.fromkeys(first.values()))
    fits_of = [(ready[k], m, s, jobs[k[0]].params) for k, m, s in distinct]
    fitted = dict(zip(distinct, beside(spark, fit, fits_of, max(r.n_rows for r in ready.values()))))
    raw = None
    for k in spots:
        runs = [((jobs[k[0]].stage, m, jobs[k[0]].feature_set, s), fitted[first[k, m, s]].copy()) for kk, m, s in fits if kk == k]
        part = _scored(ready[k], runs)
        raw = part if raw is None else raw.unionByName(part)
    raw = materialise(raw, "raw_scores")
    held = raw.where("_c").select(*KEYS, "y", F.col("raw_score").alias("score"))
    scores = raw.withColumn("score", F.col("raw_score"))
    if calibrate != "none":
        scores = CALIBRATIONS[calibrate](held, KEYS).transform(scores).withColumn("score", F.col("calibrated")).drop("calibrated")
    scores = materialise(scores.select(*KEYS, "partition", "session_id", "y", "score", "raw_score"), "scores")
    priors = {tuple(r)[:-1]: float(r["p"]) for r in held.groupBy(*KEYS).agg(F.avg("y").alias("p")).collect()}  # one row per run
    thresholds = materialise(select_threshold(
        threshold_counts(scores.where(F.col("partition") == "val"), KEYS), KEYS).select(*KEYS, "threshold"), "thresholds")
    test = scores.where(F.col("partition") == "test")
    if evaluate is not None:
        test = test.join(evaluate, "session_id", "left_semi")
    intervals = None
    if intervals_for:
        headline = test.where(F.col("feature_set").isin(list(intervals_for))).select(*KEYS, "y", "score")
        intervals = materialise(bootstrap_multi(headline, groups=KEYS, n_resamples=n_resamples), "intervals")  # per run and metric
    results = classification_report(threshold_counts(test, KEYS), thresholds, KEYS, intervals=intervals)
    estimated = estimate_prior_em(test, priors, KEYS).select(
        *KEYS, F.col("prior_source").alias("prior_calibration"), "prior_estimated")
    return Runs(scores, thresholds, materialise(results.join(F.broadcast(estimated), KEYS, "left"), "results"))  # one row per run


def run_stage_models(
    features: DataFrame, split: DataFrame, *, stages: Sequence[str] = MODEL_STAGES,
    models: Sequence[str] = ("gbt",), seeds: Sequence[int] = (42,), feature_sets: Sequence[str] = ("full",),
    imbalance: str = "class_weight", calibrate: str = "isotonic", calibration_fraction: float = 0.20,
    params: dict[str, dict] | None = None, cohort: DataFrame | None = None,
    train_on_cohort: bool = False, intervals_for: Sequence[str] = ("full",), n_resamples: int = MIN_RESAMPLES,
) -> Runs:
    """Fit and score one model per (stage, model, feature set, seed).

    The calibration slice is drawn once per stage, so every run of a stage fits
    and calibrates on the same rows. ``params`` maps a stage to tuned
    parameters. With ``cohort`` the test metrics cover those sessions only.
    Runs on ``intervals_for`` carry interval columns of ``n_resamples`` draws.
    """
    if params and len(models) != 1:
        raise ValueError("tuned parameters belong to exactly one model type")
    jobs = []
    for stage in stages:
        rows = features.where(F.col("stage") == stage).join(
            split.select("session_id", "partition"), "session_id").withColumn("y", F.col("label").cast("int"))
        train = F.col("partition") == "train"
        if cohort is not None and train_on_cohort:
            rows = rows.join(cohort.withColumn("_in", F.lit(True)), "session_id", "left")
            train = train & F.col("_in").isNotNull()
        rows = rows.withColumn("_train", train)
        sliced = stratified_slice(rows.where("_train").select("session_id", "y"), calibration_fraction, label="y")
        rows = materialise(rows.join(sliced.select("session_id", "in_slice"), "session_id", "left"), "stage_rows")
        sizes = rows.agg(
            F.count_if(F.col("_train") & (F.col("y") == 1)).alias("train_pos"),
            F.count_if(F.col("_train") & (F.col("y") == 0)).alias("train_neg"),
            F.count_if((F.col("partition") == "test") & (F.col("y") == 1)).alias("test_pos")).first()
        if not sizes["test_pos"]:
            continue
        if not sizes["train_pos"] or not sizes["train_neg"]:
            raise ValueError(f"the train rows of {stage} hold one class only")
        held = F.coalesce(F.col("in_slice"), F.lit(False))
        jobs += [Job(rows, stage, name, list(feature_names(stage, name)), [], F.col("_train") & ~held, held, (params or {}).get(stage))
                 for name in feature_sets]
    if not jobs:
        raise ValueError("the test partition holds no positive session at any stage")
    return _run_jobs(jobs, models, seeds, imbalance=imbalance, calibrate=calibrate, evaluate=cohort,
                     intervals_for=intervals_for, n_resamples=n_resamples)


def run_common_cohort(features: DataFrame, split: DataFrame, *, train_on_cohort: bool = False, **options) -> Runs:
    """Fit each stage as usual, evaluate all of them on the sessions that reach every stage."""
    cohort = materialise(common_cohort(features), "cohort")
    if cohort.isEmpty():
        raise ValueError("the cohort of sessions with all stages holds nothing")
    return run_stage_models(features, split, cohort=cohort, train_on_cohort=train_on_cohort, **options)


def run_static_models(
    table: DataFrame, *, models: Sequence[str] = ("logreg",), seeds: Sequence[int] = (42,),
    imbalance: str = "class_weight", calibrate: str = "isotonic", calibration_fraction: float = 0.20,
    params: dict | None = None,
) -> Runs:
    """The same on the split static table (``label``, ``partition`` and the static columns)."""
    rows = table.withColumn("y", F.col("label").cast("int"))
    sliced = stratified_slice(
        rows.where(F.col("partition") == "train").select("session_id", "y"), calibration_fraction, label="y")
    rows = materialise(rows.join(sliced.select("session_id", "in_slice"), "session_id", "left"), "static_rows")
    held = F.coalesce(F.col("in_slice"), F.lit(False))
    job = Job(rows, "static", "full", list(STATIC_NUMERIC), list(STATIC_CATEGORICAL),
              (F.col("partition") == "train") & ~held, held, params)
    return _run_jobs([job], models, seeds, imbalance=imbalance, calibrate=calibrate)


def static_results(runs: Runs) -> DataFrame:
    """Per-run metrics with those before calibration and after prior correction."""
    from ..functions.columns import adjust_prior

    test = runs.scores.where(F.col("partition") == "test")
    priors = runs.results.select(*KEYS, "prior_calibration", "prior_estimated")
    raw = test.select(*KEYS, "y", F.col("raw_score").alias("score"))
    moved = test.join(F.broadcast(priors), KEYS).withColumn(  # one row per run
        "score", adjust_prior(F.col("score"), F.col("prior_calibration"), F.col("prior_estimated")))

    def pick(scores, suffix, names):
        report = classification_report(threshold_counts(scores, KEYS), runs.thresholds, KEYS)
        return report.select(*KEYS, *[F.col(n).alias(f"{n}_{suffix}") for n in names])

    return (
        runs.results.withColumn("prevalence_test", F.col("prevalence"))
        .join(pick(raw, "uncalibrated", ["ece", "brier"]), KEYS)
        .join(pick(moved, "prior_corrected", ["ece", "brier", "pr_auc"]), KEYS))
