"""Queries over resampling, paired tests and their correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparisons, resampling
from ..operators.splits import common_cohort
from .artefacts import RUN, Artefacts
from .registry import query, r, rnd, rounded
from .sql_text import cte

_RUN = "stage, model, feature_set, seed"


def erfc_sql(x: str) -> str:
    """Complementary error function as a series of positive terms."""
    return (f"(1 - 2 / sqrt(pi()) * exp(-pow({x}, 2)) * list_sum(list_transform(range(0, 120), lambda k: "
            f"CASE WHEN {x} = 0 THEN 0 ELSE exp(k * ln(4) + lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln({x})) END)))")


def full(a: Artefacts):
    return a.test_scores.where(F.col("feature_set") == "full")


def averaged(a: Artefacts):
    return a.table("averaged", lambda: comparisons.seed_average(a.test_scores, ["stage", "feature_set"]))


def paired(a: Artefacts):
    """Seed-averaged scores of two feature sets side by side."""
    return a.table("paired", lambda: averaged(a).groupBy("stage", "session_id", "y")
                   .pivot("feature_set", ["full", "baseline"]).agg(F.max("score")))


cte("t_avg", """
    SELECT stage, feature_set, session_id, max(y) AS y, round(avg(score), 12) AS score FROM j_test GROUP BY 1, 2, 3""")
cte("t_pair", """
    SELECT stage, session_id, max(y) AS y, max(score) FILTER (feature_set = 'full') AS a,
      max(score) FILTER (feature_set = 'baseline') AS b FROM t_avg GROUP BY 1, 2""")
cte("t_wins", """
    SELECT p.stage, p.session_id AS pid, n.session_id AS nid,
      CASE WHEN p.a > n.a THEN 1.0e0 WHEN p.a = n.a THEN 0.5e0 ELSE 0 END AS wa,
      CASE WHEN p.b > n.b THEN 1.0e0 WHEN p.b = n.b THEN 0.5e0 ELSE 0 END AS wb
    FROM t_pair p JOIN t_pair n ON p.stage = n.stage AND p.y = 1 AND n.y = 0""")
cte("t_pos", "SELECT stage, pid, avg(wa) AS va, avg(wb) AS vb FROM t_wins GROUP BY 1, 2")
cte("t_neg", "SELECT stage, nid, avg(wa) AS va, avg(wb) AS vb FROM t_wins GROUP BY 1, 2")
cte("t_pos_cov", """
    SELECT stage, count(*) AS m, avg(va) AS auc_a, avg(vb) AS auc_b, var_samp(va) AS xx, var_samp(vb) AS yy,
      covar_samp(va, vb) AS xy FROM t_pos GROUP BY 1""")
cte("t_neg_cov", """
    SELECT stage, count(*) AS n, var_samp(va) AS xx, var_samp(vb) AS yy, covar_samp(va, vb) AS xy
    FROM t_neg GROUP BY 1""")
cte("t_cov", """
    SELECT stage, auc_a, auc_b, p.xx / m + n.xx / n AS vaa, p.yy / m + n.yy / n AS vbb, p.xy / m + n.xy / n AS vab
    FROM t_pos_cov p JOIN t_neg_cov n USING (stage)""")
cte("t_delong", """
    SELECT stage, auc_a, auc_b, auc_a - auc_b AS diff, sqrt(v) AS se_diff,
      CASE WHEN v > 0 THEN (auc_a - auc_b) / sqrt(v) ELSE 0 END AS z FROM (
        SELECT *, CASE WHEN vaa + vbb - 2 * vab > 1e-18 THEN vaa + vbb - 2 * vab ELSE 0 END AS v FROM t_cov)""")


@query("midrank", f"""
    SELECT {_RUN}, score, {rnd('avg(place)')} AS midrank FROM (
      SELECT {_RUN}, score, row_number() OVER (PARTITION BY {_RUN} ORDER BY score) AS place FROM j_test)
    GROUP BY ALL""")
def _(a: Artefacts):
    return rounded(comparisons.midrank(a.counts, RUN))


@query("seed_average", f"SELECT stage, feature_set, session_id, y, {rnd('score', 9)} AS score FROM t_avg")
def _(a: Artefacts):
    return rounded(comparisons.seed_average(a.test_scores, ["stage", "feature_set"]), 9)


@query("delong_variance", f"SELECT stage, {rnd('auc_a')} AS auc, {rnd('vaa', 7)} AS variance FROM t_cov")
def _(a: Artefacts):
    found = comparisons.delong_variance(paired(a), ["stage"], "full")
    return rounded(found.withColumn("auc", F.round(F.col("auc") + 1e-9, 6)), 7)


@query("delong_components", f"""
    SELECT stage, a, b, {r('auc_a', 'auc_b')}, {rnd('cov', 7)} AS cov FROM (
      SELECT stage, 'full' AS a, 'full' AS b, auc_a, auc_a AS auc_b, vaa AS cov FROM t_cov UNION ALL
      SELECT stage, 'full', 'baseline', auc_a, auc_b, vab FROM t_cov UNION ALL
      SELECT stage, 'baseline', 'baseline', auc_b, auc_b, vbb FROM t_cov)""")
def _(a: Artefacts):
    found = comparisons.delong_components(paired(a), ["full", "baseline"], ["stage"])
    return rounded(found.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("auc_a", "auc_b")}), 7)


_Z95 = 1.959963984540054


@query("delong_test", f"""
    SELECT stage, {r('auc_a', 'auc_b', 'diff', 'se_diff')}, {rnd('z', 5)} AS z, {rnd(erfc_sql('(abs(z) / sqrt(2))'), 5)} AS p_value,
      {rnd(f'diff - {_Z95} * se_diff')} AS ci_low, {rnd(f'diff + {_Z95} * se_diff')} AS ci_high FROM t_delong""")
def _(a: Artefacts):
    found = comparisons.delong_test(paired(a), "full", "baseline", ["stage"])
    return rounded(found.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("z", "p_value")}))


cte("t_calls", f"""
    SELECT t.stage, t.seed, t.session_id, max(y) AS y,
      max(CAST(score >= threshold AS INT)) FILTER (feature_set = 'full') AS a,
      max(CAST(score >= threshold AS INT)) FILTER (feature_set = 'baseline') AS b
    FROM j_test t JOIN m_thresholds h USING ({_RUN}) GROUP BY 1, 2, 3""")
cte("t_mc", """
    SELECT stage, seed, count(*) FILTER (a <> y AND b = y) AS n01, count(*) FILTER (a = y AND b <> y) AS n10
    FROM t_calls GROUP BY 1, 2""")
cte("t_mcnemar", f"""
    SELECT stage, seed, n01, n10, n01 + n10 < 25 AS exact,
      CASE WHEN n01 + n10 = 0 THEN 0 WHEN n01 + n10 < 25 THEN CAST(least(n01, n10) AS DOUBLE)
        ELSE pow(abs(n10 - n01) - 1, 2) / (n01 + n10) END AS statistic,
      CASE WHEN n01 + n10 = 0 THEN 1 WHEN n01 + n10 < 25 THEN least(1, 2 * list_sum(list_transform(
          range(0, least(n01, n10) + 1), lambda i: exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1)
            - (n01 + n10) * ln(2)))))
        ELSE {erfc_sql('(abs(abs(n10 - n01) - 1) / sqrt(2 * (n01 + n10)))')} END AS p_value
    FROM t_mc""")


def calls(a: Artefacts):
    keyed = a.test_scores.join(F.broadcast(a.thresholds), RUN)  # one row per run
    return keyed.withColumn("call", (F.col("score") >= F.col("threshold")).cast("int")).groupBy(
        "stage", "seed", "session_id", "y").pivot("feature_set", ["full", "baseline"]).agg(F.max("call"))


@query("mcnemar", f"SELECT stage, seed, n01, n10, exact, {r('statistic', 'p_value', digits=5)} FROM t_mcnemar")
def _(a: Artefacts):
    return rounded(comparisons.mcnemar(calls(a), "full", "baseline", ["stage", "seed"]), 5)


def seed_pairs(a: Artefacts):
    return a.results.groupBy("stage", "seed").pivot("feature_set", ["full", "baseline"]).agg(F.max("pr_auc"))


cte("w_pairs", """
    SELECT stage, seed, max(pr_auc) FILTER (feature_set = 'full') AS a, max(pr_auc) FILTER (feature_set = 'baseline') AS b
    FROM m_results GROUP BY 1, 2""")
cte("w_all", """
    SELECT stage, count(*) AS n, median(a - b) AS median_diff, bool_or(a = b) AS zeros,
      bool_and(abs(a - b) <= 1e-8 + 1e-5 * abs(b)) AS same FROM w_pairs GROUP BY 1""")
cte("w_ranked", """
    SELECT stage, d, rank() OVER (PARTITION BY stage ORDER BY abs(d))
      + (count(*) OVER (PARTITION BY stage, abs(d)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY stage, abs(d)) AS t
    FROM (SELECT stage, a - b AS d FROM w_pairs WHERE a <> b)""")
cte("w_plus", """
    SELECT stage, count(*) AS m, coalesce(sum(rk) FILTER (d > 0), 0) AS plus, sum(t * t - 1) AS tie FROM w_ranked GROUP BY 1""")
cte("w_sums", """
    SELECT b, list_sum(list_transform(range(0, 5), lambda i: ((b >> i) & 1) * (i + 1))) AS s FROM range(0, 32) AS t(b)""")
cte("w_tests", """
    SELECT stage, n, same, zeros, median_diff, least(plus, m * (m + 1) / 2 - plus) AS statistic,
      abs(least(plus, m * (m + 1) / 2 - plus) - m * (m + 1) / 4)
        / sqrt((m * (m + 1) * (2 * m + 1) - 0.5e0 * tie) / 24) / sqrt(2) AS dev,
      least(1, 2 * least((SELECT count(*) / 32.0e0 FROM w_sums WHERE s <= ceil(plus)),
        (SELECT count(*) / 32.0e0 FROM w_sums WHERE s >= floor(plus)))) AS p
    FROM w_all LEFT JOIN w_plus USING (stage)""")


@query("wilcoxon", f"""
    SELECT stage, {rnd('CASE WHEN same THEN 0 ELSE statistic END')} AS statistic, {rnd(f"CASE WHEN same THEN 1 WHEN zeros THEN {erfc_sql('dev')} ELSE p END", 5)} AS p_value,
      n AS n_pairs, {rnd('CASE WHEN same THEN 0 ELSE median_diff END')} AS median_diff, {rnd('2 / pow(2, n)')} AS min_attainable_p
    FROM w_tests""")
def _(a: Artefacts):
    found = comparisons.wilcoxon(seed_pairs(a), "full", "baseline", ["stage"])
    return rounded(found.withColumn("p_value", F.round(F.col("p_value") + 1e-9, 5)))


cte("h_ranked", """
    SELECT stage, seed, p_value, row_number() OVER (PARTITION BY stage ORDER BY p_value, seed) AS i,
      count(*) OVER (PARTITION BY stage) AS m FROM t_mcnemar""")


@query("holm", f"""
    SELECT stage, seed, {rnd('least(1, max((m - i + 1) * p_value) OVER (PARTITION BY stage ORDER BY i))', 5)} AS p_holm FROM h_ranked""")
def _(a: Artefacts):
    tests = comparisons.mcnemar(calls(a), "full", "baseline", ["stage", "seed"])
    return rounded(comparisons.holm(tests, families=["stage"]).select("stage", "seed", "p_holm"), 5)


@query("benjamini_hochberg", f"""
    SELECT stage, seed, {rnd('least(1, min(p_value * m / i) OVER (PARTITION BY stage ORDER BY i DESC))', 5)} AS p_fdr_bh FROM h_ranked""")
def _(a: Artefacts):
    tests = comparisons.mcnemar(calls(a), "full", "baseline", ["stage", "seed"])
    return rounded(comparisons.benjamini_hochberg(tests, families=["stage"]).select("stage", "seed", "p_fdr_bh"), 5)


# resampling -----------------------------------------------------------------------
@query("stratified_resample")
def _(a: Artefacts):
    one = full(a).where(F.col("seed") == 42)
    return resampling.stratified_resample(one, ["stage"])


@query("bootstrap_ci")
def _(a: Artefacts):
    one = full(a).where(F.col("seed") == 42)
    return rounded(resampling.bootstrap_ci(one, "pr_auc", ["stage"]))


@query("bootstrap_multi")
def _(a: Artefacts):
    return rounded(resampling.bootstrap_multi(full(a), groups=["stage", "seed"]))


@query("paired_bootstrap")
def _(a: Artefacts):
    return rounded(resampling.paired_bootstrap(paired(a), "full", "baseline", groups=["stage"]))


def cohort_scores(a: Artefacts):
    """Test scores of the sessions that reach every stage."""
    cohort = common_cohort(a.features)
    return a.test_scores.where(F.col("feature_set") == "full").join(cohort, "session_id", "left_semi")


@query("cohort_bootstrap")
def _(a: Artefacts):
    return resampling.cohort_bootstrap(cohort_scores(a))


_PLAN = (
    ("full", "baseline", "do all features beat plain counts"),
    ("+temporal", "baseline", "does the temporal family add to plain counts"),
)


@query("comparison_plan")
def _(a: Artefacts):
    sets = ["full", "baseline", "+temporal"]
    wide = averaged(a).where(F.col("stage") == "S1").groupBy("session_id", "y").pivot("feature_set", sets).agg(
        F.max("score"))
    chosen = a.thresholds.where((F.col("stage") == "S1") & (F.col("seed") == 42)).collect()  # one row per run
    thresholds = {t["feature_set"]: t["threshold"] for t in chosen if t["feature_set"] in sets}
    wide = wide.withColumnRenamed("+temporal", "temporal")
    plan = [tuple(x.replace("+temporal", "temporal") for x in p[:2]) + (p[2],) for p in _PLAN]
    thresholds = {k.replace("+temporal", "temporal"): v for k, v in thresholds.items()}
    return rounded(comparisons.comparison_plan(wide, plan, thresholds=thresholds))


@query("stage_comparisons")
def _(a: Artefacts):
    return rounded(comparisons.stage_comparisons(a.test_scores, a.results))
