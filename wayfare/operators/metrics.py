"""Ranking and calibration metrics from per-score counts, for many runs at once.

``scores`` holds ``groups``, ``y`` (0/1) and ``score``. Ties are collapsed
first, so every metric is a sum over distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pr_gain, pr_lift, ratio
from ..functions.ranks import ROWS_PER_CHUNK, running_totals

#: Metrics that need no threshold; reports carry intervals for them.
INTERVAL_METRICS = ("pr_auc", "pr_gain", "pr_lift", "roc_auc", "brier")


def join_runs(df: DataFrame, per_run: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Attach a table with one row per run.

    Runs are declared by the caller (stages, models, seeds), so the table is a
    short list and is broadcast: shuffling score counts on a handful of run keys
    would put each run into one task.
    """
    small = F.broadcast(per_run)
    return df.join(small, list(groups)) if groups else df.crossJoin(small)


def threshold_counts(
    scores: DataFrame, groups: Sequence[str] = (), *, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Per distinct score, descending: positives, negatives and running TP and FP."""
    groups = list(groups)
    counts = scores.groupBy(*groups, "score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    running = running_totals(
        counts, "score", ["pos", "neg"], groups, descending=True, rows_per_chunk=rows_per_chunk)
    running = running.withColumnsRenamed({"pos_cum": "tp", "neg_cum": "fp"})
    totals = running.groupBy(*groups).agg(F.max("tp").alias("n_pos"), F.max("fp").alias("n_neg"))
    return join_runs(running, totals, groups)


def ranking_metrics(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Average precision, gain, lift, ROC-AUC and Brier score from threshold counts."""
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    precision = tp / (tp + fp)
    s = F.col("score")
    out = counts.groupBy(*groups).agg(
        (F.first("n_pos") + F.first("n_neg")).alias("n"),
        F.first("n_pos").alias("n_positive"),
        F.first("n_neg").alias("_n_neg"),
        F.sum(pos * precision).alias("_ap"),
        F.sum(neg * (tp - pos + pos / 2)).alias("_above"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("_sq"),
    )
    p, n, neg_n = F.col("n_positive"), F.col("n"), F.col("_n_neg")
    prevalence, ap = p / n, ratio(F.col("_ap"), p)
    return out.select(
        *groups, "n", "n_positive", prevalence.alias("prevalence"), ap.alias("pr_auc"),
        pr_gain(ap, prevalence).alias("pr_gain"), pr_lift(ap, prevalence).alias("pr_lift"),
        pr_gain(ap, prevalence).alias("attainable_lift_fraction"),
        F.try_divide(F.col("_above"), p * neg_n).alias("roc_auc"),
        (F.col("_sq") / n).alias("brier"),
    )


def at_ranks(counts: DataFrame, groups: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The distinct score (with its TP and FP) that holds each wanted ascending rank.

    ``wanted`` has ``groups`` and a 0-based ``rank``: a fixed number of rows per
    run, so it is broadcast and every score row is compared in place.
    """
    upto = F.col("n_pos") + F.col("n_neg") - (F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg"))
    ranked = counts.select(
        *groups, "score", "tp", "fp", "n_pos", "n_neg", upto.alias("_to"),
        (upto - F.col("pos") - F.col("neg")).alias("_from"))
    a, b = ranked.alias("a"), F.broadcast(wanted).alias("b")
    on = (F.col("b.rank") >= F.col("a._from")) & (F.col("b.rank") < F.col("a._to"))
    for g in groups:
        on = on & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    rest = [c for c in wanted.columns if c not in groups]
    return a.join(b, on).select(
        *[F.col(f"a.{c}") for c in (*groups, "score", "tp", "fp", "n_pos", "n_neg")],
        *[F.col(f"b.{c}") for c in rest])


def score_quantiles(
    counts: DataFrame, groups: Sequence[str], low: float, high: float, k: int
) -> DataFrame:
    """``k`` evenly spaced linear quantiles of the scores, with the TP and FP of
    calling positive whatever scores at least the quantile."""
    groups = list(groups)
    n = counts.groupBy(*groups).agg((F.first("n_pos") + F.first("n_neg")).alias("_n"))
    spots = n.select(*groups, "_n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")).withColumn(
        "spot", (F.col("_n") - 1) * (F.lit(low) + F.col("i") * F.lit(high - low) / F.lit(k - 1)))
    wanted = spots.select(*groups, "i", "spot", F.explode(F.array(
        F.struct(F.lit("lo").alias("end"), F.floor("spot").alias("rank")),
        F.struct(F.lit("hi").alias("end"), F.ceil("spot").alias("rank")),
    )).alias("e")).select(*groups, "i", "spot", "e.*")

    def end(which, c):
        return F.max(F.when(F.col("end") == which, F.col(c)))

    found = at_ranks(counts, groups, wanted).groupBy(*groups, "i", "spot", "n_pos", "n_neg").agg(
        *[end(w, c).alias(f"_{w}_{c}") for w in ("lo", "hi") for c in ("score", "tp", "fp")])
    low_end, high_end = F.col("_lo_score"), F.col("_hi_score")
    part = F.col("spot") - F.floor("spot")
    # from the nearer end, so that the last digit does not depend on the side
    value = F.when(part < 0.5, low_end + (high_end - low_end) * part).otherwise(
        high_end - (high_end - low_end) * (1 - part))
    at_low = F.col("q_value") <= F.col("_lo_score")
    return found.withColumn("q_value", value).select(
        *groups, "i", "q_value", "n_pos", "n_neg",
        *[F.when(at_low, F.col(f"_lo_{c}")).otherwise(F.col(f"_hi_{c}")).alias(c) for c in ("tp", "fp")])


def _binned(counts: DataFrame, groups: Sequence[str], n_bins: int, strategy: str) -> DataFrame:
    """Threshold counts with a 0-based bin; edges follow the uniform or quantile rule."""
    groups = list(groups)
    if strategy == "uniform":
        edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(1, n_bins)])
        return counts.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col("score"))))
    if strategy != "quantile":
        raise ValueError(f"unknown binning strategy {strategy!r}")
    edges = score_quantiles(counts, groups, 0.0, 1.0, n_bins + 1).groupBy(*groups).agg(
        F.array_sort(F.collect_set("q_value")).alias("_edges"))  # at most n_bins + 1 values
    joined = join_runs(counts, edges, groups)
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    return joined.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("score")))).withColumn(
        "_flat", F.size("_edges") < 2)


def reliability(
    counts: DataFrame, groups: Sequence[str] = (), *, n_bins: int = 10, strategy: str = "quantile"
) -> DataFrame:
    """Mean prediction, positive share and count per non-empty bin."""
    binned = _binned(counts, groups, n_bins, strategy)
    if "_flat" in binned.columns:
        binned = binned.where(~F.col("_flat"))
    n = F.sum(F.col("pos") + F.col("neg"))
    return binned.groupBy(*groups, "bin").agg(
        (F.sum(F.col("score") * (F.col("pos") + F.col("neg"))) / n).alias("mean_predicted"),
        (F.sum("pos") / n).alias("fraction_positive"),
        n.alias("count"),
    )


def ece(
    counts: DataFrame, groups: Sequence[str] = (), *, n_bins: int = 10, strategy: str = "uniform"
) -> DataFrame:
    """Expected calibration error per run; 0 when all scores are equal under quantile bins."""
    groups = list(groups)
    bins = reliability(counts, groups, n_bins=n_bins, strategy=strategy)
    gap = F.abs(F.col("fraction_positive") - F.col("mean_predicted")) * F.col("count")
    found = bins.groupBy(*groups).agg((F.sum(gap) / F.sum("count")).alias("ece"))
    if not groups:
        return found.select(F.coalesce("ece", F.lit(0.0)).alias("ece"))
    every = counts.select(*groups).distinct()
    return every.join(found, groups, "left").withColumn("ece", F.coalesce("ece", F.lit(0.0)))


def select_threshold(
    counts: DataFrame, groups: Sequence[str] = (), *, objective: str = "f1", cost_fp: float = 1.0,
    cost_fn: float = 1.0,
) -> DataFrame:
    """Best threshold per run; the lowest wins ties.

    Every distinct score is a candidate: the running counts give all of them at once.
    """
    groups = list(groups)
    if objective not in ("f1", "cost"):
        raise ValueError(f"unknown objective {objective!r}")
    candidates = counts.withColumnRenamed("score", "threshold")
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("n_pos") - tp
    if objective == "f1":
        value = F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    else:
        value = -(F.lit(float(cost_fp)) * fp + F.lit(float(cost_fn)) * fn)
    best = F.max(F.struct(value.alias("v"), (-F.col("threshold")).alias("t")))
    return candidates.groupBy(*groups).agg(best.alias("_b")).select(
        *groups, (-F.col("_b.t")).alias("threshold"), F.col("_b.v").alias(objective))


def classification_report(
    counts: DataFrame, thresholds: DataFrame, groups: Sequence[str] = (), *, intervals: DataFrame | None = None,
    interval_metrics: Sequence[str] = INTERVAL_METRICS,
) -> DataFrame:
    """All metrics of each run at its given threshold.

    ``intervals`` is the long table of ``bootstrap_multi`` over the scores behind ``counts``, for all runs
    or some: each of ``interval_metrics`` gets ``<metric>_ci_low`` and ``<metric>_ci_high``, null for runs left out.
    """
    groups = list(groups)
    joined = join_runs(counts, thresholds, groups)
    over = F.col("score") >= F.col("threshold")
    fixed = joined.groupBy(*groups, "threshold").agg(
        F.coalesce(F.sum(F.when(over, F.col("pos"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(over, F.col("neg"))), F.lit(0)).alias("_fp"),
        F.first("n_pos").alias("_p"), F.first("n_neg").alias("_n"))
    tp, fp, p, n = (F.col(c) for c in ("_tp", "_fp", "_p", "_n"))
    fixed = fixed.select(
        *groups, "threshold",
        ratio(2 * tp, tp + fp + p).alias("f1"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, p).alias("recall"), ((tp + n - fp) / (p + n)).alias("accuracy"))
    out = ranking_metrics(counts, groups)
    for part in (ece(counts, groups, strategy="quantile"), fixed):
        out = join_runs(out, part, groups)
    if intervals is None:
        return out
    wide = F.broadcast(interval_columns(intervals, groups, interval_metrics))  # one row per run
    return out.join(wide, groups, "left") if groups else out.crossJoin(wide)


def interval_columns(
    intervals: DataFrame, groups: Sequence[str] = (), metrics: Sequence[str] = INTERVAL_METRICS,
) -> DataFrame:
    """One row per run with ``<metric>_ci_low`` and ``<metric>_ci_high``."""
    if not metrics:
        raise ValueError("no metrics given")
    return intervals.groupBy(*groups).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}")
        for m in metrics for side in ("ci_low", "ci_high")])


def aggregate_seeds(
    results: DataFrame, metrics: Sequence[str], groups: Sequence[str]
) -> DataFrame:
    """Mean and sample deviation of each metric over seeds; deviation 0 for one seed."""
    columns = [F.count(F.lit(1)).alias("n_seeds")]
    for m in metrics:
        columns.append(F.avg(m).alias(f"{m}_mean"))
        columns.append(F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))
    return results.groupBy(*groups).agg(*columns)


def roc_points(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at each distinct score."""
    return counts.select(
        *groups, "score", ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))


def pr_points(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score, with the prevalence as chance level."""
    return counts.select(
        *groups, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
        (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("prevalence"))
