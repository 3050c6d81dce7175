"""Queries over preprocessing, fits, calibration and prior shift."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import calibration, models, preprocess
from ..operators.features import FEATURE_SETS, feature_names
from ..operators.decisions import stage_performance, static_summary as summary_of
from ..operators.splits import month_split
from ..operators.stages import MODEL_STAGES
from ..operators.cleaning import prepare_static
from ..session import materialise, new_path
from ..sources.provided import MONTHS
from ..sources.schema import STATIC_CATEGORICAL, STATIC_NUMERIC
from . import runs
from .artefacts import RUN, SEEDS, Artefacts
from .registry import query, rnd, rounded
from .sql_text import cte

_RUN = "stage, model, feature_set, seed"
# A light setting of tree models.
SMALL = {"gbt": {"n_estimators": 5, "max_depth": 3}, "random_forest": {"n_estimators": 10, "max_depth": 4}}


def static_split(a: Artefacts):
    return a.table("static_split", lambda: prepare_static(month_split(a.static, months=MONTHS)))


def stage_runs(a: Artefacts) -> runs.Runs:
    """One set of stage fits that the queries on fitted scores share."""
    def build():
        found = runs.run_stage_models(
            a.features, a.split, models=("logreg",), feature_sets=tuple(FEATURE_SETS), seeds=SEEDS)
        _RUNS[(a.spark.sparkContext.applicationId, a.folder)] = found
        return found.scores

    a.table("fitted_scores", build)
    return _RUNS[(a.spark.sparkContext.applicationId, a.folder)]


_RUNS: dict[tuple, runs.Runs] = {}

# preprocessing --------------------------------------------------------------------
_NUM = ", ".join(f'"{c}"' for c in STATIC_NUMERIC)
_CAT = [c for c in STATIC_CATEGORICAL]
cte("p_rows", """
    SELECT s.* REPLACE (CASE WHEN s."Weekend" = 'TRUE' THEN '1' ELSE '0' END AS "Weekend"), idx < val_from AS train
    FROM (SELECT *, list_position(%r, "Month") - 1 AS idx FROM j_static) s, m_best""" % (list(MONTHS),))
cte("p_numbers", f"UNPIVOT (SELECT session_id, train, {_NUM} FROM p_rows) ON {_NUM} INTO NAME feature VALUE v")
cte("p_medians", "SELECT feature, median(v) AS m FROM p_numbers WHERE train GROUP BY 1")
cte("p_cells", " UNION ALL ".join(
    f"""SELECT session_id, train, '{c}' AS feature, "{c}" AS v FROM p_rows""" for c in STATIC_NUMERIC))
cte("p_filled", "SELECT c.session_id, train, c.feature, coalesce(v, m) AS v FROM p_cells c JOIN p_medians m ON c.feature = m.feature")
cte("p_scale", "SELECT feature, avg(v) AS mu, stddev_pop(v) AS sd FROM p_filled WHERE train GROUP BY 1")
cte("p_scaled", """
    SELECT p.feature, train, (v - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS v
    FROM p_filled p JOIN p_scale s ON p.feature = s.feature""")
cte("p_labels", " UNION ALL ".join(
    f"""SELECT train, '{c}' AS feature, "{c}" AS v FROM p_rows""" for c in _CAT))
cte("p_levels", """
    SELECT feature, v, c, share >= 0.01 AND (n_common + CAST(has_rare AS INT) <= 15 OR place <= 14) AS kept FROM (
      SELECT *, count(*) FILTER (share >= 0.01) OVER g AS n_common, bool_or(share < 0.01) OVER g AS has_rare,
        row_number() OVER (PARTITION BY feature ORDER BY share >= 0.01 DESC, c DESC, v DESC) AS place
      FROM (SELECT feature, v, count(*) AS c, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY feature) AS share
        FROM p_labels WHERE train GROUP BY 1, 2) WINDOW g AS (PARTITION BY feature))""")
cte("p_encoded", """
    SELECT l.feature || '=' || CASE WHEN k.kept THEN l.v ELSE 'infrequent' END AS feature, train
    FROM p_labels l LEFT JOIN p_levels k ON l.feature = k.feature AND l.v = k.v
    WHERE k.kept OR l.feature IN (SELECT feature FROM p_levels WHERE NOT kept)""")


@query("preprocess", f"""
    SELECT feature, train, count(*) FILTER (abs(v) > 1e-12) AS n_nonzero, {rnd('sum(v)', 3)} AS total, {rnd('sum(v * v)', 3)} AS total_sq
    FROM p_scaled GROUP BY 1, 2 UNION ALL
    SELECT feature, train, count(*), {rnd('CAST(count(*) AS DOUBLE)', 3)}, {rnd('CAST(count(*) AS DOUBLE)', 3)} FROM p_encoded GROUP BY 1, 2""")
def _(a: Artefacts):
    table = static_split(a)
    fitted = preprocess.preprocess(
        table.where(F.col("partition") == "train"), STATIC_NUMERIC, _CAT, scale=True)
    names = F.array(*[F.lit(n) for n in fitted.names])
    cells = fitted.transform(table).select(
        (F.col("partition") == "train").alias("train"),
        F.explode(F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("v"))).alias("c"))
    nonzero = F.abs(F.col("c.v")) > 1e-12
    out = cells.groupBy("c.feature", "train").agg(
        F.count_if(nonzero).alias("n_nonzero"), F.sum("c.v").alias("total"),
        F.sum(F.col("c.v") * F.col("c.v")).alias("total_sq"))
    return rounded(out.where(F.col("n_nonzero") > 0), 3)


@query("class_weights", f"""
    SELECT stage, n_pos, n_neg, {rnd('(n_pos + n_neg) / (2.0e0 * n_neg)')} AS weight_neg,
      {rnd('(n_pos + n_neg) / (2.0e0 * n_pos)')} AS weight_pos, {rnd('CAST(n_neg AS DOUBLE) / n_pos')} AS neg_per_pos
    FROM (SELECT stage, count(*) FILTER (label) AS n_pos, count(*) FILTER (NOT label) AS n_neg FROM j_feats GROUP BY 1)""")
def _(a: Artefacts):
    return rounded(preprocess.class_weights(a.features, "label", ["stage"]))


@query("smote_oversample")
def _(a: Artefacts):
    train = static_split(a).where(F.col("partition") == "train").withColumn("y", F.col("label").cast("int"))
    ready = preprocess.preprocess(train, STATIC_NUMERIC, scale=True).transform(train)
    return preprocess.smote_oversample(ready.select("session_id", "y", "features"))


@query("fit_models")
def _(a: Artefacts):
    def prepare(stage):
        rows = a.features.where(F.col("stage") == stage).join(
            a.split.select("session_id", "partition"), "session_id").withColumn("y", F.col("label").cast("int"))
        return materialise(rows, "fit_rows")

    def fit(task):
        rows, stage, kind = task
        train = rows.where(F.col("partition") == "train")
        return models.fit_model(train, kind, feature_names(stage), seed=42)

    tables = {stage: prepare(stage) for stage in MODEL_STAGES}
    tasks = [(tables[stage], stage, kind) for stage in MODEL_STAGES for kind in ("logreg", "random_forest", "gbt")]
    fitted = models.beside(a.spark, fit, tasks, max(t.count() for t in tables.values()))
    out = None
    for (rows, _, kind), model in zip(tasks, fitted):
        part = model.score(rows).select(
            "stage", F.lit(kind).alias("model"), "session_id", "partition", "y", F.round("score", 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("run_stage_models")
def _(a: Artefacts):
    return rounded(stage_runs(a).results)


@query("stage_performance_intervals")
def _(a: Artefacts):
    return rounded(stage_performance(stage_runs(a).results))


@query("run_common_cohort")
def _(a: Artefacts):
    return rounded(runs.run_common_cohort(a.features, a.split, models=("logreg",), seeds=SEEDS).results)


def _static_runs(a: Artefacts) -> runs.Runs:
    key = (a.spark.sparkContext.applicationId, a.folder, "static")
    if key not in _RUNS:
        _RUNS[key] = runs.run_static_models(static_split(a), models=("logreg", "gbt"), seeds=SEEDS)
    return _RUNS[key]


@query("run_static_models")
def _(a: Artefacts):
    return rounded(_static_runs(a).results)


@query("static_results")
def _(a: Artefacts):
    return rounded(runs.static_results(_static_runs(a)))


@query("static_summary")
def _(a: Artefacts):
    metrics = ["pr_auc", "roc_auc", "brier", "ece", "f1", "ece_uncalibrated", "brier_prior_corrected", "prior_estimated"]
    return rounded(summary_of(runs.static_results(_static_runs(a)), metrics))


# calibration ------------------------------------------------------------------------
_C = "stage, feature_set, seed"
cte("c_levels", f"""
    SELECT {_C}, score, avg(y) AS m, count(*) AS w FROM j_scores WHERE "partition" = 'train' GROUP BY {_C}, score""")
cte("c_sums", f"""
    SELECT {_C}, score, row_number() OVER o AS i, sum(m * w) OVER o AS sy, sum(w) OVER o AS sw
    FROM c_levels WINDOW o AS (PARTITION BY {_C} ORDER BY score)""")
cte("c_spans", f"""
    SELECT a.stage, a.feature_set, a.seed, a.i AS lo, b.i AS hi, (b.sy - coalesce(p.sy, 0)) / (b.sw - coalesce(p.sw, 0)) AS mean
    FROM c_sums a JOIN c_sums b ON a.stage = b.stage AND a.feature_set = b.feature_set AND a.seed = b.seed AND a.i <= b.i
    LEFT JOIN c_sums p ON p.stage = a.stage AND p.feature_set = a.feature_set AND p.seed = a.seed AND p.i = a.i - 1""")
# Least mean from lo to any place at or after i, then the greatest over all lo up to i.
cte("c_lower", f"""
    SELECT {_C}, lo, hi AS i, min(mean) OVER (PARTITION BY {_C}, lo ORDER BY hi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least
    FROM c_spans""")
cte("c_iso", f"SELECT {_C}, score, max(least) AS fitted FROM c_sums JOIN c_lower USING ({_C}, i) GROUP BY {_C}, score")


@query("calibrate_isotonic", f"SELECT {_C}, score, {rnd('fitted')} AS calibrated FROM c_iso")
def _(a: Artefacts):
    train = a.scores.where(F.col("partition") == "train")
    by = ["stage", "feature_set", "seed"]
    fit = calibration.calibrate_isotonic(train, by)
    return rounded(fit.transform(train.select(*by, "score").distinct()).select(*by, "score", "calibrated"))


@query("calibrate_sigmoid")
def _(a: Artefacts):
    train = materialise(a.scores.where(F.col("partition") == "train"), "calibration")
    by = ["stage", "feature_set", "seed"]
    fit = calibration.calibrate_sigmoid(train, by)
    return rounded(fit.transform(train.select(*by, "session_id", "y", "score")))


_SOURCE = 0.59
cte("e_lists", f"""
    SELECT {_RUN}, list(least(1 - 1e-12, greatest(1e-12, score))) AS ps FROM j_test GROUP BY ALL""")
cte("e_steps", f"""
    SELECT {_RUN}, ps, 0 AS i, {_SOURCE}e0 AS prior, 1.0e0 AS moved FROM e_lists UNION ALL
    SELECT {_RUN}, ps, i + 1, updated, abs(updated - prior) FROM (
      SELECT *, list_avg(list_transform(ps, lambda p: p * prior / {_SOURCE}e0 / (p * prior / {_SOURCE}e0
        + (1 - p) * (1 - prior) / (1 - {_SOURCE}e0)))) AS updated FROM e_steps WHERE i < 1000 AND moved >= 1e-8)""")
cte("e_prior", f"SELECT {_RUN}, arg_max(prior, i) AS prior, max(i) AS n, arg_max(moved, i) < 1e-8 AS done FROM e_steps GROUP BY ALL")


@query("estimate_prior_em", f"""
    SELECT {_RUN}, {rnd(str(_SOURCE))} AS prior_source, {rnd('least(1 - 1e-12, greatest(1e-12, prior))', 5)} AS prior_estimated, done AS converged
    FROM e_prior""")
def _(a: Artefacts):
    found = calibration.estimate_prior_em(a.test_scores, _SOURCE, RUN)
    return rounded(found.drop("n_iterations"), 5)


@query("correct_prior_shift", f"""
    SELECT {_RUN}, session_id, {rnd(f'p * prior / {_SOURCE}e0 / (p * prior / {_SOURCE}e0 + (1 - p) * (1 - prior) / (1 - {_SOURCE}e0))', 4)} AS corrected
    FROM (SELECT t.*, least(1 - 1e-12, greatest(1e-12, score)) AS p, least(1 - 1e-12, greatest(1e-12, prior)) AS prior
      FROM j_test t JOIN e_prior USING (stage, model, feature_set, seed))""")
def _(a: Artefacts):
    found = calibration.correct_prior_shift(a.test_scores, _SOURCE, RUN)
    return rounded(found.select(*RUN, "session_id", "corrected"), 4)


# tuning -------------------------------------------------------------------------------
def _trials(a: Artefacts):
    """The linear study of every stage with positives to validate on."""
    def build():
        path, out = new_path(a.spark, "trials"), None
        for stage in MODEL_STAGES:
            rows = a.features.where(F.col("stage") == stage).join(
                a.split.select("session_id", "partition"), "session_id").withColumn("y", F.col("label").cast("int"))
            rows = materialise(rows, "tune_rows")
            val = rows.where(F.col("partition") == "val")
            if val.where("y = 1").isEmpty():
                continue
            part = models.tune(
                rows.where(F.col("partition") == "train"), val, "logreg", feature_names(stage), stage=stage, path=path)
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no stage holds a positive validation session")
        return out

    return a.table("trials", build)


@query("tune")
def _(a: Artefacts):
    return rounded(_trials(a))


@query("load_tuned")
def _(a: Artefacts):
    trials = _trials(a)
    studies = [r["study"] for r in trials.select("study").distinct().collect()]  # one per stage
    best = F.create_map(*[F.lit(x) for name in studies for x in (name, models.load_tuned(trials, name)["C"])])
    return trials.groupBy("study").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n_trials")).select(
        "study", best[F.col("study")].alias("C"), "value", "n_trials")
