"""Queries over metrics, thresholds, result tables and decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import adjust_prior, pr_gain, pr_lift
from ..operators import decisions, metrics, resampling
from ..operators.splits import common_cohort
from .artefacts import RUN, Artefacts
from .registry import query, r, rnd, rounded
from .sql_text import cte

_RUN = "stage, model, feature_set, seed"

cte("m_rank", f"""
    SELECT {_RUN}, n_pos + n_neg AS n, n_pos AS n_positive,
      CAST(n_pos AS DOUBLE) / (n_pos + n_neg) AS prevalence,
      sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / n_pos AS pr_auc,
      CASE WHEN n_pos * n_neg > 0 THEN sum(neg * (tp - pos + pos / 2)) / (n_pos * n_neg) END AS roc_auc,
      sum(pos * pow(1 - score, 2) + neg * pow(score, 2)) / (n_pos + n_neg) AS brier
    FROM j_counts GROUP BY {_RUN}, n_pos, n_neg""")
cte("m_ranking", """
    SELECT *, CASE WHEN prevalence > 0 AND prevalence < 1 THEN (pr_auc - prevalence) / (1 - prevalence)
        ELSE 0 END AS pr_gain,
      CASE WHEN prevalence > 0 THEN pr_auc / prevalence ELSE 0 END AS pr_lift FROM (
        SELECT * REPLACE (coalesce(pr_auc, 0) AS pr_auc) FROM m_rank)""")
cte("m_edges", f"""
    SELECT {_RUN}, list_sort(list_distinct(quantile_cont(score,
      [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM j_test GROUP BY ALL""")
cte("m_binned", """
    SELECT t.*, len(list_filter(edges[2:len(edges) - 1], lambda e: e <= score)) AS bin
    FROM j_test t JOIN m_edges e USING (stage, model, feature_set, seed) WHERE len(edges) > 1""")
cte("m_bins", f"""
    SELECT {_RUN}, bin, avg(score) AS mean_predicted, avg(y) AS fraction_positive, count(*) AS "count"
    FROM m_binned GROUP BY ALL""")
cte("m_ece", f"""
    SELECT {_RUN}, sum(abs(fraction_positive - mean_predicted) * "count") / sum("count") AS ece
    FROM m_bins GROUP BY ALL""")
cte("m_uniform", f"""
    SELECT {_RUN}, sum(abs(fp - mp) * c) / sum(c) AS ece FROM (
      SELECT {_RUN}, len(list_filter([k * 0.1e0 for k in range(1, 10)],
        lambda e: e <= score)) AS bin, avg(y) AS fp, avg(score) AS mp, count(*) AS c FROM j_test GROUP BY ALL)
    GROUP BY ALL""")
cte("m_val", f"""
    SELECT {_RUN}, score, sum(y) OVER w AS tp, count(*) OVER w AS called, sum(y) OVER g AS p
    FROM (SELECT * FROM j_scores WHERE "partition" = 'val')
    WINDOW g AS (PARTITION BY {_RUN}), w AS (PARTITION BY {_RUN} ORDER BY score DESC)""")
cte("m_thresholds", f"""
    SELECT {_RUN}, score AS threshold, f1 FROM (
      SELECT *, row_number() OVER (PARTITION BY {_RUN} ORDER BY f1 DESC, score) AS k FROM (
        SELECT DISTINCT {_RUN}, score, CASE WHEN called + p > 0 THEN 2.0e0 * tp / (called + p) ELSE 0 END AS f1
        FROM m_val)) WHERE k = 1""")
cte("m_calls", f"""
    SELECT t.*, h.threshold, score >= h.threshold AS hit FROM j_test t
    JOIN m_thresholds h USING (stage, model, feature_set, seed)""")
cte("m_confusion", f"""
    SELECT *, tp + fp + fn + tn AS n_test, CAST(tp + fn AS DOUBLE) / (tp + fp + fn + tn) AS prevalence,
      CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS "precision",
      CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
      CASE WHEN tp > 0 THEN 2.0e0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
      CAST(tp + fp AS DOUBLE) / (tp + fp + fn + tn) AS flag_rate,
      CASE WHEN tp > 0 THEN CAST(fp AS DOUBLE) / tp END AS fp_per_tp,
      CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy
    FROM (SELECT {_RUN}, threshold, count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp,
      count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (NOT hit AND y = 0) AS tn
      FROM m_calls GROUP BY ALL)""")
cte("m_confused", """
    SELECT *, 2 * prevalence / (1 + prevalence) AS trivial_positive_f1,
      f1 - 2 * prevalence / (1 + prevalence) AS f1_over_trivial FROM m_confusion""")
cte("m_results", f"""
    SELECT a.*, a.pr_gain AS attainable_lift_fraction, coalesce(e.ece, 0) AS ece, c.threshold, c.f1,
      c."precision", c.recall, c.accuracy, a.pr_auc / nullif(a.prevalence, 0) AS pr_auc_lift
    FROM m_ranking a JOIN m_confused c USING (stage, model, feature_set, seed)
    LEFT JOIN m_ece e USING (stage, model, feature_set, seed)""")


@query("threshold_counts", f"SELECT {_RUN}, score, pos, neg, tp, fp, n_pos, n_neg FROM j_counts")
def _(a: Artefacts):
    return metrics.threshold_counts(a.test_scores, RUN)


def _ranking(name: str, columns: tuple[str, ...]) -> None:
    @query(name, f"SELECT {_RUN}, {r(*columns)} FROM m_ranking")
    def _(a: Artefacts):
        return rounded(metrics.ranking_metrics(a.counts, RUN).select(*RUN, *columns))


for _name in ("pr_auc", "roc_auc", "brier"):
    _ranking(_name, (_name,))


@query("pr_gain", f"SELECT {_RUN}, {r('prevalence', 'pr_auc', 'pr_gain')} FROM m_ranking")
def _(a: Artefacts):
    m = metrics.ranking_metrics(a.counts, RUN).select(*RUN, "prevalence", "pr_auc")
    return rounded(m.withColumn("pr_gain", pr_gain(F.col("pr_auc"), F.col("prevalence"))))


@query("pr_lift", f"SELECT {_RUN}, {r('prevalence', 'pr_auc', 'pr_lift')} FROM m_ranking")
def _(a: Artefacts):
    m = metrics.ranking_metrics(a.counts, RUN).select(*RUN, "prevalence", "pr_auc")
    return rounded(m.withColumn("pr_lift", pr_lift(F.col("pr_auc"), F.col("prevalence"))))


@query("ece", f"""
    SELECT {_RUN}, {rnd('coalesce(q.ece, 0)')} AS ece_quantile, {rnd('u.ece')} AS ece_uniform
    FROM m_uniform u LEFT JOIN m_ece q USING (stage, model, feature_set, seed)""")
def _(a: Artefacts):
    quantile = metrics.ece(a.counts, RUN, strategy="quantile").withColumnRenamed("ece", "ece_quantile")
    uniform = metrics.ece(a.counts, RUN).withColumnRenamed("ece", "ece_uniform")
    return rounded(quantile.join(uniform, RUN))


@query("reliability", f"""
    SELECT {_RUN}, CAST(bin AS INT) AS bin, {r('mean_predicted', 'fraction_positive')}, "count" FROM m_bins""")
def _(a: Artefacts):
    return rounded(metrics.reliability(a.counts, RUN))


@query("select_threshold", f"SELECT {_RUN}, threshold, {rnd('f1')} AS f1 FROM m_thresholds")
def _(a: Artefacts):
    val = a.scores.where(F.col("partition") == "val")
    return rounded(metrics.select_threshold(metrics.threshold_counts(val, RUN), RUN))


_REPORT = ("prevalence", "pr_auc", "pr_gain", "pr_lift", "attainable_lift_fraction", "roc_auc", "brier",
           "ece", "threshold", "f1", "precision", "recall", "accuracy")


@query("classification_report", f"SELECT {_RUN}, n, n_positive, {r(*_REPORT)} FROM m_results")
def _(a: Artefacts):
    return rounded(metrics.classification_report(a.counts, a.thresholds, RUN))


@query("report_intervals", f"""
    SELECT {_RUN}, n, {r(*metrics.INTERVAL_METRICS)}, {', '.join(f"true AS {m}_inside" for m in metrics.INTERVAL_METRICS)}
    FROM m_results WHERE feature_set = 'full'""")
def _(a: Artefacts):
    """Reports of the headline set with intervals of 2,000 shared draws; a point lies inside its interval."""
    headline = F.col("feature_set") == "full"
    found = resampling.bootstrap_multi(a.test_scores.where(headline).select(*RUN, "y", "score"), groups=RUN)
    report = metrics.classification_report(a.counts.where(headline), a.thresholds.where(headline), RUN, intervals=found)
    inside = [F.col(m).between(F.col(f"{m}_ci_low"), F.col(f"{m}_ci_high")).alias(f"{m}_inside") for m in metrics.INTERVAL_METRICS]
    return rounded(report.select(*RUN, "n", *metrics.INTERVAL_METRICS, *inside))


_AGG = ("pr_auc", "roc_auc", "brier", "ece", "f1")


@query("aggregate_seeds", f"""
    SELECT stage, model, feature_set, count(*) AS n_seeds, {', '.join(
        f"{rnd(f'avg({m})')} AS {m}_mean, {rnd(f'coalesce(stddev_samp({m}), 0)')} AS {m}_std" for m in _AGG)}
    FROM m_results GROUP BY 1, 2, 3""")
def _(a: Artefacts):
    return rounded(metrics.aggregate_seeds(a.results, _AGG, ["stage", "model", "feature_set"]))


@query("stage_results", f"SELECT {_RUN}, n, n_positive, {r(*_REPORT, 'pr_auc_lift')} FROM m_results")
def _(a: Artefacts):
    return rounded(decisions.stage_results(a.results))


def _mean_sd(name: str, mean: str, sd: str) -> str:
    return f"{rnd(f'avg({name})')} AS {mean}, {rnd(f'stddev_samp({name})')} AS {sd}"


@query("improvement_curve", f"""
    SELECT stage, min(n) AS n_test, {rnd('min(prevalence)')} AS prevalence,
      {_mean_sd('pr_auc', 'pr_auc_mean', 'pr_auc_std')}, {_mean_sd('pr_gain', 'pr_gain_mean', 'pr_gain_std')},
      {rnd('avg(pr_auc_lift)')} AS pr_auc_lift_mean, {_mean_sd('roc_auc', 'roc_auc_mean', 'roc_auc_std')},
      {rnd('avg(ece)')} AS ece_mean, count(*) AS n_seeds
    FROM m_results WHERE feature_set = 'full' GROUP BY 1""")
def _(a: Artefacts):
    return rounded(decisions.improvement_curve(a.results))


@query("ablation_table", f"""
    SELECT stage, feature_set, {_mean_sd('pr_auc', 'pr_auc_mean', 'pr_auc_std')}, count(*) AS n_seeds
    FROM m_results GROUP BY 1, 2""")
def _(a: Artefacts):
    return rounded(decisions.ablation_table(a.results))


cte("m_cohort_counts", f"""
    SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS n_pos, sum(neg) OVER g AS n_neg
    FROM (SELECT {_RUN}, score, sum(y) AS pos, sum(1 - y) AS neg FROM j_test WHERE feature_set = 'full'
      AND session_id IN (SELECT session_id FROM j_feats GROUP BY 1 HAVING count(*) = 3) GROUP BY ALL)
    WINDOW g AS (PARTITION BY {_RUN}), w AS (PARTITION BY {_RUN} ORDER BY score DESC)""")
cte("m_cohort_results", f"""
    SELECT *, pr_auc / nullif(prevalence, 0) AS pr_auc_lift FROM (
      SELECT {_RUN}, CAST(n_pos + n_neg AS BIGINT) AS n, CAST(n_pos AS DOUBLE) / (n_pos + n_neg) AS prevalence,
        coalesce(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / nullif(n_pos, 0), 0) AS pr_auc,
        CASE WHEN n_pos * n_neg > 0 THEN CAST(sum(neg * (tp - pos + pos / 2)) AS DOUBLE) / CAST(n_pos * n_neg AS DOUBLE) END AS roc_auc
      FROM m_cohort_counts GROUP BY {_RUN}, n_pos, n_neg)""")


@query("cohort_table", f"""
    SELECT stage, min(n) AS n_eval, {rnd('min(prevalence)')} AS prevalence,
      {_mean_sd('pr_auc', 'pr_auc_mean', 'pr_auc_sd')}, {_mean_sd('roc_auc', 'roc_auc_mean', 'roc_auc_sd')},
      {_mean_sd('pr_auc_lift', 'lift_mean', 'lift_sd')}, count(*) AS n_seeds
    FROM m_cohort_results GROUP BY 1""")
def _(a: Artefacts):
    cohort = a.test_scores.where(F.col("feature_set") == "full").join(common_cohort(a.features), "session_id", "left_semi")
    return rounded(decisions.cohort_table(metrics.ranking_metrics(metrics.threshold_counts(cohort, RUN), RUN)))


@query("stage_performance", f"""
    SELECT stage, {', '.join(f"{rnd(f'{"min" if c == "prevalence" else "avg"}({c})')} AS {c}" for c in (
        'prevalence', 'pr_auc', 'pr_auc_lift', 'roc_auc', 'ece', 'brier'))}
    FROM m_results WHERE feature_set = 'full' GROUP BY 1""")
def _(a: Artefacts):
    return rounded(decisions.stage_performance(a.results))


_LOGGED = ("pr_auc", "roc_auc", "f1", "pr_auc_lift", "threshold")


@query("run_metrics", " UNION ALL ".join(
    f"SELECT '{m}.' || stage || '.' || feature_set AS \"key\", {_mean_sd(m, 'mean', 'sd')} FROM m_results "
    f"WHERE {m} IS NOT NULL GROUP BY stage, feature_set" for m in _LOGGED))
def _(a: Artefacts):
    return rounded(decisions.run_metrics(a.results, _LOGGED))


# decisions ---------------------------------------------------------------------
_RATES = ", ".join(f"({x}e0)" for x in decisions.FLAG_RATES)
cte("d_flagged", f"""
    SELECT {_RUN}, flag_rate, k, avg(y) FILTER (pos <= k) - max(base) AS incremental_precision, max(base) AS prevalence
    FROM (
      SELECT {_RUN}, y, flag_rate, avg(y) OVER g AS base,
        row_number() OVER (PARTITION BY {_RUN}, flag_rate ORDER BY score DESC, md5(session_id || '|0')) AS pos,
        CAST(greatest(1, round_even(flag_rate * count(*) OVER g, 0)) AS BIGINT) AS k
      FROM j_test, (VALUES {_RATES}) AS rates(flag_rate)
      WINDOW g AS (PARTITION BY {_RUN}, flag_rate))
    GROUP BY ALL""")


@query("flag_precision", f"SELECT {_RUN}, flag_rate, k, {r('prevalence', 'incremental_precision')} FROM d_flagged")
def _(a: Artefacts):
    return rounded(decisions.flag_precision(a.test_scores, a.counts, groups=RUN))


@query("flag_sweep", f"""
    SELECT flag_rate, stage, {rnd('avg(incremental_precision)', 4)} AS incremental_precision_mean,
      {rnd('stddev_samp(incremental_precision)', 4)} AS incremental_precision_sd,
      CASE WHEN avg(incremental_precision) > 0 THEN {rnd('1 / avg(incremental_precision)', 1)} END
        AS contacts_per_incremental, count(*) AS n_seeds
    FROM (SELECT * REPLACE (round(incremental_precision + 1e-9, 6) AS incremental_precision) FROM d_flagged) WHERE feature_set = 'full' GROUP BY 1, 2""")
def _(a: Artefacts):
    full = a.test_scores.where(F.col("feature_set") == "full")
    flagged = decisions.flag_precision(full, a.counts.where(F.col("feature_set") == "full"), groups=RUN)
    return rounded(decisions.flag_sweep(rounded(flagged)))


_RATES_OF = ("prevalence", "threshold", "precision", "recall", "f1", "trivial_positive_f1", "f1_over_trivial",
             "flag_rate", "fp_per_tp")


@query("confusion", f"SELECT {_RUN}, tp, fp, fn, tn, n_test, {r(*_RATES_OF)} FROM m_confused")
def _(a: Artefacts):
    return rounded(decisions.confusion(a.test_scores, a.thresholds, RUN).select(
        *RUN, "tp", "fp", "fn", "tn", "n_test", *_RATES_OF))


@query("error_structure", f"""
    SELECT stage, n_seeds, n_test, {', '.join(f'"{c}", "{c}_sd"' for c in _RATES_OF if c != 'f1_over_trivial')},
      {rnd('f1 - trivial_positive_f1', 4)} AS f1_over_trivial, f1_over_trivial_sd
    FROM (SELECT stage, count(*) AS n_seeds, min(n_test) AS n_test, {', '.join(
        f'{rnd(f"""avg("{c}")""", 4)} AS "{c}", {rnd(f"""stddev_samp("{c}")""", 4)} AS "{c}_sd"' for c in _RATES_OF)}
      FROM m_confused WHERE feature_set = 'full' GROUP BY 1)""")
def _(a: Artefacts):
    full = decisions.confusion(a.test_scores.where(F.col("feature_set") == "full"), a.thresholds, RUN)
    return rounded(decisions.error_structure(full), 4)


@query("error_analysis", f"""
    SELECT stage, n_test, {r('prevalence', 'threshold', digits=4)}, tp, fp, fn, tn,
      {r('precision', 'recall', 'f1', 'trivial_positive_f1', digits=4)},
      round(round(f1, 4) - round(trivial_positive_f1, 4) + 1e-9, 4) + 0.0e0 AS f1_over_trivial,
      {r('flag_rate', digits=4)}, {r('fp_per_tp', digits=2)}
    FROM m_confused WHERE feature_set = 'full' AND seed = 42""")
def _(a: Artefacts):
    one = (F.col("feature_set") == "full") & (F.col("seed") == 42)
    return rounded(decisions.error_analysis(decisions.confusion(a.test_scores.where(one), a.thresholds, RUN)), 4)


@query("decision_economics", f"""
    SELECT stage, count(*) AS n_seeds, {rnd('avg(prevalence)', 4)} AS prevalence,
      {rnd('avg("precision")', 4)} AS precision_mean, {rnd('stddev_samp("precision")', 4)} AS precision_sd,
      {rnd('avg(inc)', 4)} AS incremental_mean, {rnd('stddev_samp(inc)', 4)} AS incremental_sd,
      CASE WHEN stddev_samp(inc) > 0 THEN {rnd('avg(inc) / stddev_samp(inc)', 2)} END AS sd_from_zero,
      CASE WHEN avg(inc) > 0 THEN {rnd('1 / avg(inc)', 1)} END AS contacts_per_incremental,
      {rnd('min(1 / inc) FILTER (inc > 0)', 1)} AS contacts_min, {rnd('max(1 / inc) FILTER (inc > 0)', 1)} AS contacts_max,
      count(*) FILTER (inc <= 0) AS seeds_at_or_below_chance
    FROM (SELECT *, "precision" - prevalence AS inc FROM m_results WHERE feature_set = 'full') GROUP BY 1""")
def _(a: Artefacts):
    return rounded(decisions.decision_economics(a.results))


@query("roc_points", f"""
    SELECT {_RUN}, score, {rnd('CAST(fp AS DOUBLE) / greatest(n_neg, 1)')} AS fpr,
      {rnd('CAST(tp AS DOUBLE) / greatest(n_pos, 1)')} AS tpr FROM j_counts""")
def _(a: Artefacts):
    return rounded(metrics.roc_points(a.counts, RUN))


@query("pr_points", f"""
    SELECT {_RUN}, score, {rnd('CAST(tp AS DOUBLE) / (tp + fp)')} AS "precision",
      {rnd('CAST(tp AS DOUBLE) / greatest(n_pos, 1)')} AS recall,
      {rnd('CAST(n_pos AS DOUBLE) / (n_pos + n_neg)')} AS prevalence FROM j_counts""")
def _(a: Artefacts):
    return rounded(metrics.pr_points(a.counts, RUN))


@query("confusion_normalised", f"""
    SELECT {_RUN}, actual, predicted, n, {rnd('CAST(n AS DOUBLE) / greatest(sum(n) OVER (PARTITION BY stage, model, feature_set, seed, actual), 1)')} AS share
    FROM (SELECT {_RUN}, 0 AS actual, 0 AS predicted, tn AS n FROM m_confusion UNION ALL
      SELECT {_RUN}, 0, 1, fp FROM m_confusion UNION ALL SELECT {_RUN}, 1, 0, fn FROM m_confusion UNION ALL
      SELECT {_RUN}, 1, 1, tp FROM m_confusion)""")
def _(a: Artefacts):
    return rounded(decisions.confusion_normalised(a.test_scores, a.thresholds, RUN))


_ODDS = "(least(1 - 1e-12, greatest(1e-12, score)))"


@query("adjust_prior", f"""
    SELECT {_RUN}, session_id, score, {rnd(f'{_ODDS} * 0.2 / 0.5 / ({_ODDS} * 0.2 / 0.5 + (1 - {_ODDS}) * 0.8 / 0.5)')} AS adjusted
    FROM j_test""")
def _(a: Artefacts):
    adjusted = adjust_prior(F.col("score"), F.lit(0.5), F.lit(0.2))
    return rounded(a.test_scores.select(*RUN, "session_id", "score", adjusted.alias("adjusted")))
