"""Paired tests between score sets: DeLong, McNemar, Wilcoxon and their correction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.probability import chi2_one_p, normal_quantile, sign_p, signed_rank, two_sided_p
from .metrics import join_runs, threshold_counts
from .resampling import joint_counts, paired_bootstrap

# The pre-declared feature-set contrasts, the richer set first.
CONTRASTS = (
    ("+temporal", "baseline", "does the temporal family add to plain counts"),
    ("baseline+entropy_velocity", "baseline", "do entropy and velocity add to plain counts"),
    ("+entropy_velocity", "+temporal", "do entropy and velocity add to the temporal family"),
)


def seed_average(scores: DataFrame, groups: Sequence[str], key: str = "session_id") -> DataFrame:
    """Mean score over seeds per row; 12 digits, so that summation order does not split ties."""
    return scores.groupBy(*groups, key).agg(
        F.max("y").alias("y"), F.round(F.avg("score"), 12).alias("score"))


def midrank(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Ascending 1-based rank of each distinct score, averaged within its ties."""
    n = F.col("n_pos") + F.col("n_neg")
    own = F.col("pos") + F.col("neg")
    return counts.select(*groups, "score", (n - F.col("tp") - F.col("fp") + (own + 1) / 2).alias("midrank"))


def _placements(scores: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Per column and distinct score: the share of the other class it beats."""
    long = scores.select(*groups, "y", F.explode(F.array(*[
        F.struct(F.lit(c).alias("axis"), F.col(c).alias("score")) for c in columns])).alias("s")).select(
        *groups, "y", "s.*")
    c = threshold_counts(long, [*groups, "axis"])
    return c.select(
        *groups, "axis", "score", "pos", "neg", "n_pos", "n_neg",
        ((F.col("n_neg") - F.col("fp") + F.col("neg") / 2) / F.col("n_neg")).alias("beats"),
        ((F.col("tp") - F.col("pos") / 2) / F.col("n_pos")).alias("beaten"))


def delong_components(
    scores: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()
) -> DataFrame:
    """AUCs and covariance of every pair of score columns on the same rows.

    Both structural components depend on a row's score only, so the covariance
    is a weighted sum over distinct score combinations.
    """
    columns, groups = list(columns), list(groups)
    sized = scores.groupBy(*groups).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    few = sized.where((F.col("p") < 2) | (F.col("q") < 2)).first()
    if few is not None:
        raise ValueError(f"each class needs at least 2 rows, got {few['p']} positive, {few['q']} negative")
    placed = _placements(scores, columns, groups)
    aucs = placed.groupBy(*groups, "axis").agg(
        (F.sum(F.col("pos") * F.col("beats")) / F.first("n_pos")).alias("auc"))
    placed = join_runs(placed, aucs, [*groups, "axis"]).select(
        *groups, "axis", "score", "auc", "n_pos", "n_neg",
        (F.col("beats") - F.col("auc")).alias("dp"), (F.col("beaten") - F.col("auc")).alias("dn"))
    joint = joint_counts(scores, columns, groups)
    out = None
    for i, a in enumerate(columns):
        for b in columns[i:]:
            sides = joint
            for tag, c in (("a", a), ("b", b)):
                side = placed.where(F.col("axis") == c).select(
                    *groups, F.col("score").alias(c if tag == "a" or a != b else f"{c}__b"),
                    *[F.col(x).alias(f"{x}_{tag}") for x in ("auc", "dp", "dn")],
                    *([F.col("n_pos"), F.col("n_neg")] if tag == "a" else []))
                if a == b and tag == "b":
                    sides = sides.withColumns({f"{x}_b": F.col(f"{x}_a") for x in ("auc", "dp", "dn")})
                else:
                    sides = sides.join(side, [*groups, c])
            w = F.col("n")
            pos = F.sum(F.when(F.col("y") == 1, w * F.col("dp_a") * F.col("dp_b")))
            neg = F.sum(F.when(F.col("y") == 0, w * F.col("dn_a") * F.col("dn_b")))
            m, n = F.first("n_pos"), F.first("n_neg")
            part = sides.groupBy(*groups).agg(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.first("auc_a").alias("auc_a"),
                F.first("auc_b").alias("auc_b"),
                (pos / (m - 1) / m + neg / (n - 1) / n).alias("cov"))
            out = part if out is None else out.unionByName(part)
    return out


def delong_variance(scores: DataFrame, groups: Sequence[str] = (), column: str = "score") -> DataFrame:
    """AUC and its variance per run."""
    return delong_components(scores, [column], groups).select(
        *groups, F.col("auc_a").alias("auc"), F.col("cov").alias("variance"))


def delong_test(
    scores: DataFrame, a: str, b: str, groups: Sequence[str] = (), *, alpha: float = 0.05
) -> DataFrame:
    """Paired two-sided test of AUC(a) - AUC(b) with its interval."""
    groups = list(groups)
    parts = delong_components(scores, [a, b], groups)
    pick = lambda x, y, c: F.max(F.when((F.col("a") == x) & (F.col("b") == y), F.col(c)))
    wide = parts.groupBy(*groups).agg(
        pick(a, b, "auc_a").alias("auc_a"), pick(a, b, "auc_b").alias("auc_b"),
        (pick(a, a, "cov") + pick(b, b, "cov") - 2 * pick(a, b, "cov")).alias("_v"))
    diff = F.col("auc_a") - F.col("auc_b")
    wide = wide.select(*groups, "auc_a", "auc_b", diff.alias("diff"),
                       # identical scores leave only rounding noise
                       F.sqrt(F.when(F.col("_v") > 1e-18, F.col("_v")).otherwise(0.0)).alias("se_diff"))
    wide = wide.withColumn("z", F.when(F.col("se_diff") > 0, F.col("diff") / F.col("se_diff")).otherwise(0.0))
    half = F.lit(normal_quantile(1 - alpha / 2)) * F.col("se_diff")
    return wide.withColumn("p_value", two_sided_p("z")).withColumns(
        {"ci_low": F.col("diff") - half, "ci_high": F.col("diff") + half})


def mcnemar(
    calls: DataFrame, a: str, b: str, groups: Sequence[str] = (), *, exact: bool | None = None
) -> DataFrame:
    """Paired disagreement of two 0/1 call columns against ``y``.

    Exact binomial below 25 discordant rows, corrected chi-square from there on.
    """
    groups = list(groups)
    right_a, right_b = F.col(a) == F.col("y"), F.col(b) == F.col("y")
    n = F.col("n01") + F.col("n10")
    use_exact = (n < 25) if exact is None else F.lit(exact)
    counted = calls.groupBy(*groups).agg(
        F.count_if(~right_a & right_b).alias("n01"), F.count_if(right_a & ~right_b).alias("n10"))
    counted = counted.withColumn("exact", (n == 0) | use_exact)
    gap = F.abs(F.col("n10") - F.col("n01")) - 1.0
    counted = counted.withColumn(
        "statistic", F.when(n == 0, 0.0).when(F.col("exact"), F.least("n01", "n10").cast("double"))
        .otherwise(F.try_divide(gap * gap, n)))
    return counted.withColumn(
        "p_value", F.when(n == 0, 1.0).when(F.col("exact"), sign_p(F.col("n10"), n))
        .otherwise(chi2_one_p("statistic")))


def wilcoxon(pairs: DataFrame, a: str, b: str, groups: Sequence[str], order: str = "seed") -> DataFrame:
    """Signed-rank test of two metric columns over seeds, one group per comparison.

    A group has one row per seed, so it is a handful of rows.
    """
    groups = list(groups)
    kinds = dict(pairs.dtypes)
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups] + [
        "statistic double", "p_value double", "n_pairs bigint", "median_diff double", "min_attainable_p double"])

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf.sort_values(order)[c].to_numpy(float) for c in (a, b))
        n = len(x)
        floor = 2.0 / 2**n if n < 20 else 0.0
        same = np.allclose(x, y)
        stat, p = (0.0, 1.0) if same else signed_rank(x, y)
        middle = 0.0 if same else float(np.median(x - y))
        return pd.DataFrame([[*key, stat, p, n, middle, floor]], columns=[
            *groups, "statistic", "p_value", "n_pairs", "median_diff", "min_attainable_p"])

    return pairs.groupBy(*groups).applyInPandas(test, schema)


def _family(p: str, families: Sequence[str], descending: bool):
    order = F.col(p).desc() if descending else F.col(p).asc()
    return Window.partitionBy(*families).orderBy(order)


def holm(tests: DataFrame, p: str = "p_value", families: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Step-down adjustment over each family of declared tests (a short list)."""
    w = _family(p, families, False)
    ranked = tests.withColumn("_i", F.row_number().over(w)).withColumn(
        "_m", F.count(F.lit(1)).over(Window.partitionBy(*families)))
    raw = (F.col("_m") - F.col("_i") + 1) * F.col(p)
    upto = Window.partitionBy(*families).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.max(raw).over(upto))).drop("_i", "_m")


def benjamini_hochberg(
    tests: DataFrame, p: str = "p_value", families: Sequence[str] = (), name: str = "p_fdr_bh"
) -> DataFrame:
    """False-discovery-rate adjustment over each family of declared tests."""
    w = _family(p, families, False)
    ranked = tests.withColumn("_i", F.row_number().over(w)).withColumn(
        "_m", F.count(F.lit(1)).over(Window.partitionBy(*families)))
    raw = F.col("_m") / F.col("_i") * F.col(p)
    down = Window.partitionBy(*families).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(raw).over(down))).drop("_i", "_m")


ADJUSTERS = {"holm": holm, "fdr_bh": benjamini_hochberg}


def _adjuster(correction: str):
    if correction not in ADJUSTERS:
        raise ValueError(f"unknown correction {correction!r}, expected one of {list(ADJUSTERS)}")
    return ADJUSTERS[correction]


def comparison_plan(
    scores: DataFrame, plan: Sequence[tuple[str, str, str]], *, thresholds: dict[str, float] | None = None,
    correction: str = "holm", alpha: float = 0.05, n_resamples: int = 2000, seed: int = 42,
) -> DataFrame:
    """Every declared pair of score columns: DeLong, paired PR-AUC bootstrap, McNemar.

    ``scores`` has ``y`` and one column per model. p-values are corrected over
    the whole plan; ``thresholds`` turns scores into calls for McNemar.
    """
    adjust = _adjuster(correction)
    if not plan:
        raise ValueError("the comparison plan is empty")
    rows = None
    for a, b, why in plan:
        if not why.strip():
            raise ValueError("every comparison needs a rationale")
        for c in (a, b):
            if c not in scores.columns:
                raise KeyError(f"no scores for model {c!r}")
        d = delong_test(scores, a, b, alpha=alpha).select(
            F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.lit(why).alias("rationale"),
            F.col("auc_a").alias("roc_auc_a"), F.col("auc_b").alias("roc_auc_b"),
            F.col("diff").alias("roc_auc_diff"), F.col("ci_low").alias("roc_auc_diff_ci_low"),
            F.col("ci_high").alias("roc_auc_diff_ci_high"), F.col("p_value").alias("delong_p"))
        pr = paired_bootstrap(scores, a, b, n_resamples=n_resamples, alpha=alpha, seed=seed).select(
            F.col("point").alias("pr_auc_diff"), F.col("ci_low").alias("pr_auc_diff_ci_low"),
            F.col("ci_high").alias("pr_auc_diff_ci_high"))
        row = d.crossJoin(F.broadcast(pr))  # one row each
        if thresholds is not None:
            calls = scores.select("y", (F.col(a) >= thresholds[a]).cast("int").alias("call_a"),
                                  (F.col(b) >= thresholds[b]).cast("int").alias("call_b"))
            mc = mcnemar(calls, "call_a", "call_b").select(
                F.col("p_value").alias("mcnemar_p"), F.col("n01").alias("mcnemar_n01"),
                F.col("n10").alias("mcnemar_n10"))
            row = row.crossJoin(F.broadcast(mc))
        rows = row if rows is None else rows.unionByName(row)
    out = adjust(rows, "delong_p", name=f"delong_p_{correction}")
    if thresholds is not None:
        out = adjust(out, "mcnemar_p", name=f"mcnemar_p_{correction}")
    return out.withColumns({
        "significant": F.col(f"delong_p_{correction}") < alpha, "correction": F.lit(correction),
        "alpha": F.lit(alpha), "family_size": F.lit(len(plan))})


def stage_comparisons(
    scores: DataFrame, results: DataFrame, *, contrasts=CONTRASTS, correction: str = "holm",
    alpha: float = 0.05, n_resamples: int = 2000, seed: int = 42,
) -> DataFrame:
    """The declared feature-set contrasts at every stage, corrected over all of them.

    ``scores``: stage, feature_set, seed, session_id, y, score; ``results``: the
    per-seed metrics of the same runs.
    """
    adjust = _adjuster(correction)
    mean = seed_average(scores, ["stage", "feature_set"])
    sets = sorted({s for c in contrasts for s in c[:2]})
    wide = mean.groupBy("stage", "session_id", "y").pivot("feature_set", sets).agg(F.max("score"))
    seeds = results.groupBy("stage", "seed").pivot("feature_set", sets).agg(F.max("pr_auc"))
    rows = None
    for a, b, why in contrasts:
        pair = wide.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).select(
            "stage", "y", F.col(f"`{a}`").alias("sa"), F.col(f"`{b}`").alias("sb"))
        boot = paired_bootstrap(pair, "sa", "sb", groups=["stage"], n_resamples=n_resamples,
                                alpha=alpha, seed=seed).select(
            "stage", F.col("point").alias("pr_auc_diff"), "ci_low", "ci_high")
        both = seeds.select("stage", "seed", F.col(f"`{a}`").alias("pa"), F.col(f"`{b}`").alias("pb")).where(
            F.col("pa").isNotNull() & F.col("pb").isNotNull())
        means = both.groupBy("stage").agg(F.avg("pa").alias("pr_auc_a"), F.avg("pb").alias("pr_auc_b"),
                                          F.count(F.lit(1)).alias("n_seeds"))
        test = wilcoxon(both, "pa", "pb", ["stage"]).select(
            "stage", F.col("p_value").alias("wilcoxon_p"),
            F.col("min_attainable_p").alias("wilcoxon_min_attainable_p"))
        row = boot.join(means, "stage").join(test, "stage").select(
            "stage", F.lit(a).alias("feature_set_a"), F.lit(b).alias("feature_set_b"),
            F.lit(why).alias("rationale"), "pr_auc_a", "pr_auc_b", "pr_auc_diff", "ci_low", "ci_high",
            ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("excludes_zero"),
            "wilcoxon_p", "wilcoxon_min_attainable_p", "n_seeds")
        rows = row if rows is None else rows.unionByName(row)
    out = adjust(rows, "wilcoxon_p", name=f"wilcoxon_p_{correction}")
    return out.withColumns({
        "correction": F.lit(correction),
        "family_size": F.count(F.lit(1)).over(Window.partitionBy()).cast("int")})
