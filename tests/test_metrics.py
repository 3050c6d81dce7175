"""Metrics, thresholds, resampling and paired tests against plain NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfare.functions import ranks
from wayfare.functions.probability import signed_rank
from wayfare.operators import calibration, comparisons, decisions, metrics, resampling


def ap(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.append(s[1:] != s[:-1], True)
    tp, n = np.cumsum(y)[last], (np.arange(len(y)) + 1)[last]
    return float(np.sum(np.diff(np.append(0, tp)) / y.sum() * tp / n))


def auc(y, s):
    p, q = s[y == 1], s[y == 0]
    return float(((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q)))


def ece_of(y, s, edges):
    idx = np.clip(np.digitize(s, edges[1:-1]), 0, len(edges) - 2)
    return sum((idx == b).mean() * abs(y[idx == b].mean() - s[idx == b].mean()) for b in set(idx))


def counts_of(scores, c="a", **kw):
    return metrics.threshold_counts(scores[0].select("y", F.col(c).alias("score")), **kw)


def test_many_bounds_are_searched_not_compared(spark):
    """The work of a value grows with the logarithm of the bounds, which grow with the rows."""
    bounds = [i / 8 for i in range(2000)]
    values = [-1.0, 0.0, 0.01, 0.125, 77.3, 249.875, 1e9, math.nan, -0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    table = df.select("v", ranks.value_chunk(F.col("v"), bounds).alias("c"), ranks.value_chunk(F.col("v"), bounds[:8]).alias("few"))
    for r in table.collect():
        for got, known in ((r["c"], bounds), (r["few"], bounds[:8])):
            v = math.inf if r["v"] is not None and math.isnan(r["v"]) else r["v"]
            assert got == (0 if v is None else sum(b < v for b in known) + sum(b <= v for b in known))
    plan = df.select(ranks.value_chunk(F.col("v"), bounds))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_quantile_edges_on_whole_ranks_are_the_scores_there(spark):
    """With 31 scores the tenths fall on whole ranks; 0.1 * 3 would lie a digit beyond rank 9."""
    for n in (11, 31, 101):
        df = spark.createDataFrame([(i % 2, i / 128) for i in range(n)], "y int, score double")
        got = metrics.reliability(metrics.threshold_counts(df)).collect()
        width = (n - 1) // 10
        assert {r["bin"]: r["count"] for r in got} == {b: width + (b == 9) for b in range(10)}


@pytest.mark.parametrize("chunked", [False, True])
def test_ranking_metrics(scores, chunked):
    _, y, a, _ = scores
    row = metrics.ranking_metrics(counts_of(scores, **({"rows_per_chunk": 50} if chunked else {}))).first()
    pi = y.mean()
    assert row["pr_auc"] == pytest.approx(ap(y, a))
    assert row["roc_auc"] == pytest.approx(auc(y, a))
    assert row["brier"] == pytest.approx(np.mean((a - y) ** 2))
    assert row["pr_gain"] == pytest.approx((ap(y, a) - pi) / (1 - pi))
    assert row["pr_lift"] == pytest.approx(ap(y, a) / pi)


def test_degenerate_classes(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.4)], "y int, score double")
    row = metrics.ranking_metrics(metrics.threshold_counts(df)).first()
    assert row["pr_gain"] == 0.0 and row["pr_lift"] == 0.0 and row["roc_auc"] is None


def test_ece_and_reliability(spark, scores):
    _, y, a, _ = scores
    c = counts_of(scores)
    assert metrics.ece(c).first()["ece"] == pytest.approx(ece_of(y, a, np.linspace(0, 1, 11)))
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    assert metrics.ece(c, strategy="quantile").first()["ece"] == pytest.approx(ece_of(y, a, edges))
    assert metrics.reliability(c).agg(F.sum("count")).first()[0] == len(y)
    flat = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, score double")
    assert metrics.ece(metrics.threshold_counts(flat), strategy="quantile").first()["ece"] == 0.0
    with pytest.raises(ValueError):
        metrics.ece(c, strategy="odd")


def best(y, s, candidates, value):
    top = (0.5, -np.inf)
    for t in candidates:
        v = value(y, s >= t)
        if v > top[1]:
            top = (t, v)
    return top


def f1(y, hit):
    d = 2 * (hit & (y == 1)).sum() + (hit & (y == 0)).sum() + (~hit & (y == 1)).sum()
    return 2 * (hit & (y == 1)).sum() / d if d else 0.0


def test_select_threshold_tries_every_score(scores):
    _, y, a, b = scores
    assert len(np.unique(a)) > 512
    for c, s, candidates in (("a", a, np.unique(a)), ("b", b, np.unique(b))):
        got = metrics.select_threshold(counts_of(scores, c)).first()
        want = best(y, s, candidates, f1)
        assert got["threshold"] == pytest.approx(want[0], abs=1e-12) and got["f1"] == pytest.approx(want[1])
    cost = metrics.select_threshold(counts_of(scores, "b"), objective="cost", cost_fp=1, cost_fn=8).first()
    want = best(y, b, np.unique(b), lambda y, h: -((h & (y == 0)).sum() + 8 * (~h & (y == 1)).sum()))
    assert cost["threshold"] == pytest.approx(want[0]) and cost["cost"] == want[1]


def test_flag_precision_cases(scores):
    df, y, a, b = scores
    rows = df.select("session_id", "y", F.col("b").alias("score"))
    got = {r["flag_rate"]: r for r in decisions.flag_precision(rows, counts_of(scores, "b"), (0.05, 1.0)).collect()}
    assert got[1.0]["incremental_precision"] == pytest.approx(0.0, abs=1e-12)
    assert got[0.05]["k"] == 75
    floor = np.sort(b)[::-1][74]
    sure, tied = y[b > floor], y[b == floor]
    low = (sure.sum() + max(0, 75 - len(sure) - (tied == 0).sum())) / 75
    high = (sure.sum() + min(tied.sum(), 75 - len(sure))) / 75
    assert low <= got[0.05]["incremental_precision"] + y.mean() <= high
    with pytest.raises(ValueError):
        decisions.flag_precision(rows, counts_of(scores, "b"), (0.0,))


def test_confusion(scores):
    df, y, a, _ = scores
    t = df.sparkSession.createDataFrame([(0.5,)], "threshold double")
    row = decisions.confusion(df.select("y", F.col("a").alias("score")), t).first()
    hit = a >= 0.5
    assert (row["tp"], row["fp"]) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum())
    assert row["f1"] == pytest.approx(f1(y, hit))


def naive_delong(y, s):
    p, q = s[:, y == 1], s[:, y == 0]
    win = np.array([(u[:, None] > v).astype(float) + 0.5 * (u[:, None] == v) for u, v in zip(p, q)])
    v01, v10 = win.mean(axis=2), win.mean(axis=1)
    return win.mean(axis=(1, 2)), np.cov(v01) / p.shape[1] + np.cov(v10) / q.shape[1]


def test_delong(scores):
    df, y, a, b = scores
    aucs, cov = naive_delong(y, np.vstack([a, b]))
    got = {(r["a"], r["b"]): r for r in comparisons.delong_components(df, ["a", "b"]).collect()}
    assert got["a", "a"]["cov"] == pytest.approx(cov[0, 0])
    assert got["a", "b"]["cov"] == pytest.approx(cov[0, 1])
    test = comparisons.delong_test(df, "a", "b").first()
    z = (aucs[0] - aucs[1]) / math.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    assert test["z"] == pytest.approx(z) and test["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    same = comparisons.delong_test(df.withColumn("c", F.col("a")), "a", "c").first()
    assert (same["diff"], same["p_value"]) == (0.0, 1.0)
    with pytest.raises(ValueError):
        comparisons.delong_test(df.where("y = 0"), "a", "b")


def test_mcnemar(spark):
    def run(n01, n10, **kw):
        rows = [(1, 0, 1)] * n01 + [(1, 1, 0)] * n10 + [(1, 1, 1)] * 5
        return comparisons.mcnemar(spark.createDataFrame(rows, "y int, a int, b int"), "a", "b", **kw).first()

    assert run(0, 0)["p_value"] == 1.0
    small = run(2, 8)
    assert small["exact"] and small["p_value"] == pytest.approx(2 * sum(math.comb(10, i) for i in range(3)) / 1024)
    big = run(10, 30)
    assert not big["exact"] and big["statistic"] == pytest.approx(19**2 / 40)
    assert not run(2, 8, exact=False)["exact"]


def test_signed_rank():
    stat, p = signed_rank(np.arange(1, 6.0), np.zeros(5))
    assert (stat, p) == (0.0, 0.0625)
    stat, p = signed_rank(np.array([1, -2, 3, -4, 5.0]), np.zeros(5))
    assert stat == 6.0 and p == pytest.approx(0.8125)


def test_adjustments(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "n string, p_value double")
    h = {r["n"]: r["p_holm"] for r in comparisons.holm(df).collect()}
    assert h == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5})
    b = {r["n"]: r["p_fdr_bh"] for r in comparisons.benjamini_hochberg(df).collect()}
    assert b == pytest.approx({"a": 0.04, "c": 0.04 * 4 / 3, "b": 0.04 * 4 / 3, "d": 0.5})


def naive_bootstrap(y, fn, n=2000, seed=1):
    rng = np.random.default_rng(seed)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    out = []
    for _ in range(n):
        i = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        out.append(fn(i))
    return np.percentile(out, [2.5, 97.5])


def test_bootstrap_interval(scores):
    df, y, a, _ = scores
    table = df.select("y", F.col("a").alias("score"))
    row = resampling.bootstrap_ci(table, "pr_auc").first()
    low, high = naive_bootstrap(y, lambda i: ap(y[i], a[i]))
    assert row["point"] == pytest.approx(ap(y, a)) and row["n_valid"] == 2000
    assert row["ci_low"] == pytest.approx(low, abs=0.012) and row["ci_high"] == pytest.approx(high, abs=0.012)
    with pytest.raises(ValueError):
        resampling.bootstrap_ci(table, "pr_auc", n_resamples=100)
    with pytest.raises(ValueError):
        resampling.bootstrap_multi(table, [])


def test_bootstrap_over_cells_agrees_with_one_cell(scores):
    df, y, a, b = scores
    one = resampling.resampled_metrics(df, ["a", "b"], n_resamples=500)
    many = resampling.resampled_metrics(df, ["a", "b"], n_resamples=500, cell_rows=100)
    for t in (one, many):
        assert t.count() == 1000
    def spread(t):
        return {r["axis"]: r for r in t.groupBy("axis").agg(
            F.avg("pr_auc").alias("m"), F.stddev("pr_auc").alias("s"), F.avg("roc_auc").alias("u"),
            F.avg("brier").alias("q")).collect()}
    x, z = spread(one), spread(many)
    for c, v in (("a", a), ("b", b)):
        assert x[c]["m"] == pytest.approx(z[c]["m"], abs=0.01)
        assert x[c]["s"] == pytest.approx(z[c]["s"], rel=0.25)
        assert z[c]["u"] == pytest.approx(auc(y, v), abs=0.01)
        assert z[c]["q"] == pytest.approx(np.mean((v - y) ** 2), abs=0.005)
    # both columns of a resample are drawn together
    pair = lambda t: t.groupBy("r").pivot("axis", ["a", "b"]).agg(F.first("brier")).select(F.corr("a", "b")).first()[0]
    assert pair(many) == pytest.approx(pair(one), abs=0.15)


def test_cells_are_drawn_once_a_run_and_block(spark, scores, tmp_path, monkeypatch):
    """Not once for each of their ranges, which would grow with the square of the ranges."""
    drawn, note = resampling._cell_draws, str(tmp_path)

    def noted(*args):
        import uuid
        open(f"{note}/{uuid.uuid4().hex}", "w").close()
        return drawn(*args)

    monkeypatch.setattr(resampling, "_cell_draws", noted)
    df = scores[0].select("y", F.col("a").alias("score")).coalesce(1)
    monkeypatch.setattr(resampling, "_BLOCK", 1000)
    resampling.resampled_metrics(df, ["score"], cell_rows=20).count()
    tasks = len(list(tmp_path.iterdir()))
    assert tasks <= 2 * 64  # blocks times tasks, below one for each of some 100 ranges and block


def test_one_shared_score_is_its_own_range(spark):
    rows = [(i % 4 == 0 and 1 or 0, 0.5 if i % 2 else i / 4000, float(i % 7)) for i in range(4000)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    many = resampling.resampled_metrics(df, ["a", "b"], n_resamples=250, cell_rows=200)
    y, a = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert many.where("axis = 'a'").agg(F.avg("roc_auc")).first()[0] == pytest.approx(auc(y, a), abs=0.01)


def test_draws_are_computed_in_parts_of_bounded_size(monkeypatch):
    """The parts hold what one draw of the whole block holds."""
    rnd = np.random.default_rng(5)
    pdf = pd.DataFrame({"score": rnd.random(300), "y": rnd.integers(0, 2, 300), "n": 2, "_c0": rnd.integers(0, 3, 300)})
    cells = [((int(c),), int(y), int(n)) for (c, y), n in pdf.groupby(["_c0", "y"])["n"].sum().items()]

    def drawn(at_once):
        monkeypatch.setattr(resampling, "_AT_ONCE", at_once)
        draws = resampling._cell_draws(cells, (), 0, 50, 42)
        parts = [d for _, d in resampling._row_draws(pdf, ["score"], ["_c0"], draws, (), 0, 50, 42)]
        return [draws[y][1] for y in (0, 1)], resampling._by_range(*draws[1], 0), parts

    (some, ranges, parts), (all_cells, all_ranges, whole) = drawn(1000), drawn(1 << 40)
    assert len(whole) == 1 and len(parts) > 10 and max(p.size for p in parts) <= 1000
    assert np.array_equal(np.concatenate(parts), whole[0])
    assert all(np.array_equal(a, b) for a, b in zip((*some, *ranges[1:]), (*all_cells, *all_ranges[1:])))


def test_resample_keeps_class_sizes(scores):
    df, y, *_ = scores
    table = df.select("y", F.col("a").alias("score"))
    for cell_rows in (50_000, 100):
        drawn = resampling.stratified_resample(table, cell_rows=cell_rows).groupBy("y").agg(
            F.sum("n").alias("n"), F.sum("drawn").alias("d")).collect()
        assert all(r["n"] == r["d"] for r in drawn) and len(drawn) == 2


def test_paired_bootstrap_and_plan(scores):
    df, y, a, b = scores
    row = resampling.paired_bootstrap(df, "a", "b").first()
    low, high = naive_bootstrap(y, lambda i: ap(y[i], a[i]) - ap(y[i], b[i]))
    assert row["point"] == pytest.approx(ap(y, a) - ap(y, b))
    assert row["ci_low"] == pytest.approx(low, abs=0.015) and row["ci_high"] == pytest.approx(high, abs=0.015)
    with pytest.raises(ValueError):
        comparisons.comparison_plan(df, [])
    with pytest.raises(ValueError):
        comparisons.comparison_plan(df, [("a", "b", " ")])
    with pytest.raises(KeyError):
        comparisons.comparison_plan(df, [("a", "zz", "why")])
    with pytest.raises(ValueError):
        comparisons.comparison_plan(df, [("a", "b", "why")], correction="none")


def test_cohort_bootstrap_needs_a_shared_cohort(spark):
    rows = [(s, f"x{i}", i % 2, (i * k % 10) / 10, 1) for k, s in ((3, "S1"), (7, "S2"), (1, "S3")) for i in range(40)]
    schema = "stage string, session_id string, y int, score double, seed int"
    table = resampling.cohort_bootstrap(spark.createDataFrame(rows, schema)).collect()
    assert {(r["metric"], r["target"]) for r in table} >= {("lift", "S1"), ("roc_auc", "S3-S1")} and len(table) == 12
    with pytest.raises(ValueError):
        resampling.cohort_bootstrap(spark.createDataFrame(rows[:-1], schema))


def test_prior_em_recovers_a_known_prior(spark):
    rng = np.random.default_rng(5)
    y = rng.random(20000) < 0.1
    x = rng.normal(loc=y * 1.5)
    p = 1 / (1 + np.exp(-(1.5 * x - 1.125)))  # calibrated at prior one half
    df = spark.createDataFrame([(float(v),) for v in np.round(p, 3)], "score double")
    row = calibration.estimate_prior_em(df, 0.5).first()
    assert row["converged"] and row["prior_estimated"] == pytest.approx(0.1, abs=0.015)
    early = calibration.estimate_prior_em(df, 0.5, max_iterations=3).first()
    prior, q = 0.5, np.clip(np.round(p, 3), 1e-12, 1 - 1e-12)
    for _ in range(3):
        prior = np.mean(q * prior / (q * prior + (1 - q) * (1 - prior)))
    assert early["prior_estimated"] == pytest.approx(prior) and not early["converged"]
    moved = calibration.correct_prior_shift(df, 0.5).agg(F.avg("corrected")).first()[0]
    assert moved == pytest.approx(row["prior_estimated"], abs=1e-6)


def test_calibrators(spark):
    rng = np.random.default_rng(2)
    s = np.round(rng.random(2000), 2)
    y = (rng.random(2000) < s**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, y int")
    for fit in (calibration.calibrate_isotonic, calibration.calibrate_sigmoid):
        out = fit(df).transform(df).select("score", "calibrated").distinct().orderBy("score").collect()
        values = [r["calibrated"] for r in out]
        assert all(b >= a - 1e-12 for a, b in zip(values, values[1:]))
        assert abs(np.mean([dict(out)[v] for v in s]) - y.mean()) < 0.02


def _pooled(s, y):
    """Pool adjacent violators, one value per distinct score."""
    stack = []
    for v in np.unique(s).tolist():
        stack.append([[v], float(y[s == v].sum()), int((s == v).sum())])
        while len(stack) > 1 and stack[-2][1] / stack[-2][2] >= stack[-1][1] / stack[-1][2]:
            b = stack.pop()
            stack[-1] = [stack[-1][0] + b[0], stack[-1][1] + b[1], stack[-1][2] + b[2]]
    return {v: t / n for block, t, n in stack for v in block}


@pytest.mark.parametrize(("parts", "most"), [(1, 1 << 20), (17, 1 << 20), (17, 0)])
def test_isotonic_fit_of_several_runs(spark, monkeypatch, parts, most):
    rng = np.random.default_rng(9)
    rows, want, outside = [], {}, {}
    for run, noise in (("up", 0.2), ("down", -1.0), ("flat", 0.0), ("one", 0.5)):
        s = np.round(rng.random(1 if run == "one" else 600), 3)
        y = (rng.random(len(s)) < np.clip(0.5 + noise * (s - 0.5) * 3, 0, 1)).astype(int)
        rows += [(run, float(a), int(b)) for a, b in zip(s, y)]
        want |= {(run, v): f for v, f in _pooled(s, y).items()}
        x = np.array(sorted(v for r, v in want if r == run))
        probes = [-1.0, 2.0, *((x[:-1] + x[1:]) / 2)[:50]]
        outside |= {(run, float(q)): float(np.interp(q, x, [want[run, v] for v in x])) for q in probes}
    monkeypatch.setattr(calibration, "MOST_KNOTS", most)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        fit = calibration.calibrate_isotonic(spark.createDataFrame(rows, "run string, score double, y int"), ["run"])
        asked = spark.createDataFrame(list(want | outside), "run string, score double")
        got = {(r["run"], r["score"]): r["calibrated"] for r in fit.transform(asked).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == pytest.approx(want | outside)


def test_prior_em_of_several_runs(spark):
    rng = np.random.default_rng(3)
    runs = {"a": (rng.beta(2, 5, 500), 0.3), "b": (rng.beta(5, 1, 400), 0.02), "c": (rng.random(300) * 1e-4, 0.5), "d": (np.full(50, 0.25), 0.25)}
    rows = [(k, float(v)) for k, (s, _) in runs.items() for v in s]
    found = calibration.estimate_prior_em(
        spark.createDataFrame(rows, "run string, score double"), {(k,): p for k, (_, p) in runs.items()}, ["run"])
    for r in found.collect():
        s, prior = runs[r["run"]]
        q, source, done, i = np.clip(s, 1e-12, 1 - 1e-12), prior, False, 0
        while not done and i < 1000:
            a, b = q * prior / source, (1 - q) * (1 - prior) / (1 - source)
            prior, done, i = np.mean(a / (a + b)), abs(np.mean(a / (a + b)) - prior) < 1e-8, i + 1
        assert (r["converged"], r["prior_estimated"]) == (done, pytest.approx(prior, abs=1e-8))
        assert abs(r["n_iterations"] - i) <= 1
