"""Result tables and decision tables over scores and per-run metrics.

Tables named ``results`` have one row per run (stage, model, feature set,
seed); they are small whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even, ratio
from ..functions.ranks import hash_rank
from .metrics import join_runs

# Default contact budgets.
FLAG_RATES = (0.01, 0.02, 0.05, 0.10, 0.20, 0.30, 0.50, 1.00)


def stage_results(results: DataFrame) -> DataFrame:
    """Per-run rows with the lift of PR-AUC over the prevalence."""
    return results.withColumn("pr_auc_lift", F.try_divide("pr_auc", "prevalence"))


def improvement_curve(results: DataFrame, feature_set: str = "full") -> DataFrame:
    """Mean and deviation per stage, next to N and prevalence."""
    return (
        stage_results(results).where(F.col("feature_set") == feature_set)
        .groupBy("stage")
        .agg(
            F.min("n").alias("n_test"), F.min("prevalence").alias("prevalence"),
            F.avg("pr_auc").alias("pr_auc_mean"), F.stddev_samp("pr_auc").alias("pr_auc_std"),
            F.avg("pr_gain").alias("pr_gain_mean"), F.stddev_samp("pr_gain").alias("pr_gain_std"),
            F.avg("pr_auc_lift").alias("pr_auc_lift_mean"),
            F.avg("roc_auc").alias("roc_auc_mean"), F.stddev_samp("roc_auc").alias("roc_auc_std"),
            F.avg("ece").alias("ece_mean"), F.count(F.lit(1)).alias("n_seeds"),
        )
    )


def ablation_table(results: DataFrame) -> DataFrame:
    return results.groupBy("stage", "feature_set").agg(
        F.avg("pr_auc").alias("pr_auc_mean"), F.stddev_samp("pr_auc").alias("pr_auc_std"),
        F.count(F.lit(1)).alias("n_seeds"))


def static_summary(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per model, best PR-AUC first."""
    columns = [F.count(F.lit(1)).alias("n_seeds")]
    columns += [F.avg(m).alias(f"{m}_mean") for m in metrics]
    columns += [F.stddev_samp(m).alias(f"{m}_std") for m in metrics]
    return results.groupBy("model").agg(*columns).orderBy(F.desc("pr_auc_mean"), "model")


def cohort_table(results: DataFrame) -> DataFrame:
    """Mean and deviation per stage on the shared cohort."""
    lift = F.try_divide("pr_auc", "prevalence")
    return results.groupBy("stage").agg(
        F.min("n").alias("n_eval"), F.min("prevalence").alias("prevalence"),
        F.avg("pr_auc").alias("pr_auc_mean"), F.stddev_samp("pr_auc").alias("pr_auc_sd"),
        F.avg("roc_auc").alias("roc_auc_mean"), F.stddev_samp("roc_auc").alias("roc_auc_sd"),
        F.avg(lift).alias("lift_mean"), F.stddev_samp(lift).alias("lift_sd"),
        F.count(F.lit(1)).alias("n_seeds"))


def stage_performance(results: DataFrame, feature_set: str = "full") -> DataFrame:
    """Seed means per stage; interval columns are averaged when present."""
    names = ["pr_auc", "pr_auc_ci_low", "pr_auc_ci_high", "pr_auc_lift", "roc_auc", "roc_auc_ci_low",
             "roc_auc_ci_high", "ece", "brier"]
    table = stage_results(results).where(F.col("feature_set") == feature_set)
    return table.groupBy("stage").agg(
        F.min("prevalence").alias("prevalence"),
        *[F.avg(c).alias(c) for c in names if c in table.columns])


def run_metrics(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long form ``metric.stage.feature_set`` with mean and deviation over seeds."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in metrics])
    return (
        stage_results(results).select("stage", "feature_set", F.explode(pairs).alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy(F.concat_ws(".", "p.metric", "stage", "feature_set").alias("key"))
        .agg(F.avg("p.value").alias("mean"), F.stddev_samp("p.value").alias("sd"))
    )


def dataset_statistics(prevalence: DataFrame, total: DataFrame) -> DataFrame:
    """Prevalence table with each stage's share of the corpus; ``total`` is one row ``n``."""
    return prevalence.crossJoin(F.broadcast(total)).withColumn(
        "share_of_corpus", F.col("n_sessions") / F.col("n")).drop("n")


def flag_precision(
    scores: DataFrame, counts: DataFrame, rates=FLAG_RATES, groups: Sequence[str] = (), *,
    key: str = "session_id", seed: int = 0,
) -> DataFrame:
    """Precision in the top ``max(1, round(rate n))`` scores minus the prevalence.

    Everything above the cut score comes from the running counts. Only rows tied
    at the cut score are ordered, by a hash of their key.
    """
    if any(not 0 < r <= 1 for r in rates):
        raise ValueError(f"flag rates must lie in (0, 1], got {rates}")
    groups = list(groups)
    n = F.col("n_pos") + F.col("n_neg")
    rate = F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("flag_rate")
    sizes = counts.groupBy(*groups).agg(F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    wanted = sizes.select(*groups, rate, n.alias("_n"), (F.col("n_pos") / n).alias("prevalence")).withColumn(
        "k", F.greatest(F.lit(1), half_even(F.col("flag_rate") * F.col("_n"))))
    a, b = counts.alias("a"), F.broadcast(wanted).alias("b")  # one row per run and rate
    before = F.col("a.tp") + F.col("a.fp") - F.col("a.pos") - F.col("a.neg")
    on = (before < F.col("b.k")) & (F.col("b.k") <= F.col("a.tp") + F.col("a.fp"))
    for g in groups:
        on = on & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    cut = a.join(b, on).select(
        *[F.col(f"b.{g}") for g in groups], "b.flag_rate", "b.k", "b.prevalence", "a.score",
        (F.col("a.tp") - F.col("a.pos")).alias("above_pos"), (F.col("b.k") - before).alias("take"))
    tied = scores.select(*groups, "score", key, "y").join(
        F.broadcast(cut.select(*groups, "flag_rate", "score", "take")), [*groups, "score"])
    ranked = hash_rank(tied, key, seed, [*groups, "flag_rate"])
    hits = ranked.where(F.col("rank") <= F.col("take")).groupBy(*groups, "flag_rate").agg(
        F.sum("y").alias("tie_pos"))
    return cut.join(hits, [*groups, "flag_rate"]).select(
        *groups, "flag_rate", "k", "prevalence",
        ((F.col("above_pos") + F.col("tie_pos")) / F.col("k") - F.col("prevalence"))
        .alias("incremental_precision"))


def flag_sweep(flagged: DataFrame) -> DataFrame:
    """Mean and deviation over seeds per stage and budget; contacts null when not positive."""
    return (
        flagged.groupBy("flag_rate", "stage")
        .agg(F.avg("incremental_precision").alias("m"),
             F.stddev_samp("incremental_precision").alias("s"), F.count(F.lit(1)).alias("n_seeds"))
        .select(
            "flag_rate", "stage", F.round("m", 4).alias("incremental_precision_mean"),
            F.round("s", 4).alias("incremental_precision_sd"),
            F.when(F.col("m") > 0, F.round(1 / F.col("m"), 1)).alias("contacts_per_incremental"),
            "n_seeds")
    )


def confusion(scores: DataFrame, thresholds: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the rates derived from them, per run."""
    groups = list(groups)
    joined = join_runs(scores, thresholds, groups)
    hit, y = F.col("score") >= F.col("threshold"), F.col("y") == 1
    counted = joined.groupBy(*groups, "threshold").agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    out = counted.withColumns({
        "n_test": n, "prevalence": (tp + fn) / n, "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
    }).withColumns({
        "f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        "trivial_positive_f1": 2 * F.col("prevalence") / (1 + F.col("prevalence")),
        "flag_rate": (tp + fp) / n,
        "fp_per_tp": F.try_divide(fp, tp),
    })
    return out.withColumn("f1_over_trivial", F.col("f1") - F.col("trivial_positive_f1"))


def error_structure(confusions: DataFrame) -> DataFrame:
    """Mean and deviation over seeds per stage; the margin from the rounded parts."""
    names = ("prevalence", "threshold", "flag_rate", "precision", "recall", "f1",
             "trivial_positive_f1", "f1_over_trivial", "fp_per_tp")
    columns = [F.count(F.lit(1)).alias("n_seeds"), F.min("n_test").alias("n_test")]
    for c in names:
        columns += [F.round(F.avg(c), 4).alias(c), F.round(F.stddev_samp(c), 4).alias(f"{c}_sd")]
    return confusions.groupBy("stage").agg(*columns).withColumn(
        "f1_over_trivial", F.round(F.col("f1") - F.col("trivial_positive_f1"), 4))


def error_analysis(confusions: DataFrame) -> DataFrame:
    """One run's confusion table, rounded for print; the margin from rounded parts."""
    r4 = lambda c: F.round(c, 4).alias(c)
    return confusions.select(
        "stage", "n_test", r4("prevalence"), r4("threshold"), "tp", "fp", "fn", "tn",
        r4("precision"), r4("recall"), r4("f1"), r4("trivial_positive_f1"),
        F.round(F.round("f1", 4) - F.round("trivial_positive_f1", 4), 4).alias("f1_over_trivial"),
        r4("flag_rate"), F.round("fp_per_tp", 2).alias("fp_per_tp"))


def decision_economics(results: DataFrame, feature_set: str = "full") -> DataFrame:
    """Contacts per conversion beyond a blanket rule, with the spread over seeds."""
    inc = F.col("precision") - F.col("prevalence")
    contacts = F.when(inc > 0, 1 / inc)
    grouped = results.where(F.col("feature_set") == feature_set).groupBy("stage").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("prevalence"), 4).alias("prevalence"),
        F.round(F.avg("precision"), 4).alias("precision_mean"),
        F.round(F.stddev_samp("precision"), 4).alias("precision_sd"),
        F.avg(inc).alias("_m"), F.stddev_samp(inc).alias("_s"),
        F.round(F.min(contacts), 1).alias("contacts_min"),
        F.round(F.max(contacts), 1).alias("contacts_max"),
        F.count_if(inc <= 0).alias("seeds_at_or_below_chance"))
    return grouped.select(
        "stage", "n_seeds", "prevalence", "precision_mean", "precision_sd",
        F.round("_m", 4).alias("incremental_mean"), F.round("_s", 4).alias("incremental_sd"),
        F.when(F.col("_s") > 0, F.round(F.col("_m") / F.col("_s"), 2)).alias("sd_from_zero"),
        F.when(F.col("_m") > 0, F.round(1 / F.col("_m"), 1)).alias("contacts_per_incremental"),
        "contacts_min", "contacts_max", "seeds_at_or_below_chance")


def confusion_normalised(scores: DataFrame, thresholds: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The 2x2 counts per run in long form, each row class normalised to 1."""
    groups = list(groups)
    counts = confusion(scores, thresholds, groups)
    cells = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
        for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ])
    return counts.select(*groups, "fn", "tp", "tn", "fp", F.explode(cells).alias("c")).select(
        *groups, "c.*",
        ratio(F.col("c.n"), F.when(F.col("c.actual") == 1, F.col("tp") + F.col("fn"))
              .otherwise(F.col("tn") + F.col("fp"))).alias("share"))


