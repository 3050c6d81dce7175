"""Attribution against brute force, table operators on small examples, quality and agreement."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wayfare.functions import ranks
from wayfare.operators import attribution as at
from wayfare.operators import models, preprocess, quality, sequences
from wayfare.session import materialise

LONG = "stage string, session_id string, feature string, value double, shap double"


def brute(f, x, background):
    """Shapley values by all subsets, interventional over the background."""
    n = len(x)
    def v(subset):
        mixed = background.copy()
        mixed[:, list(subset)] = x[list(subset)]
        return f(mixed).mean()

    phi = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                phi[i] += w * (v((*s, i)) - v(s))
    return phi


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(160, 4)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=160) > 0).astype(int)
    data = [(f"s{i:03d}", int(y[i]), *map(float, x[i])) for i in range(160)]
    return spark.createDataFrame(data, "session_id string, y int, a double, b double, c double, d double"), x


@pytest.mark.parametrize("kind, params", [
    ("gbt", {"n_estimators": 4, "max_depth": 3, "subsample": 1.0}),
    ("random_forest", {"n_estimators": 4, "max_depth": 3}),
    ("logreg", {}),
])
def test_attribution_equals_brute_force(rows, kind, params):
    df, x = rows
    fitted = models.fit_model(df, kind, ["a", "b", "c", "d"], seed=3, params=params)
    names = fitted.preprocessor.names
    got = at.stage_attribution(fitted, df.limit(6), df, background_size=15, seed=1).collect()
    chosen = fitted.preprocessor.transform(at.hash_sample(df, 15, 1))
    from pyspark.ml.functions import vector_to_array

    background = np.array([r[0] for r in chosen.select(vector_to_array("features")).collect()])
    if kind == "logreg":
        w = fitted.estimator.coefficients.toArray()
        f = lambda m: m @ w
    else:
        leaves = at.tree_leaves(fitted.estimator)

        def f(m):
            return sum(v * np.all([(m[:, j] > lo) & (m[:, j] <= hi) for j, (lo, hi) in box.items()] or
                                  [np.ones(len(m), bool)], axis=0) for v, box in leaves)

        # the leaves reproduce the model's own output
        scored = fitted.score(df).select("session_id", "score").collect()
        p = {r["session_id"]: r["score"] for r in scored}
        margins = {r["session_id"]: float(f(np.array([r["x"]]))[0]) for r in got}
        for k, m in margins.items():
            want = 1 / (1 + math.exp(-m)) if kind == "gbt" else m
            assert p[k] == pytest.approx(want, abs=1e-9)
    assert names == ["a", "b", "c", "d"] and len(got) == 6
    for r in got:
        assert np.array(r["phi"]) == pytest.approx(brute(f, np.array(r["x"]), background), abs=1e-9)


def test_stage_quality_explains_perturbed_rows_anew(spark, rows):
    df, _ = rows
    kept = F.when(F.col("session_id") < "s100", "train").otherwise("val")
    explained = at.explain_rows(df.withColumn("partition", kept), ["a", "b", "c", "d"], stage="S1", model="gbt",
                                params={"n_estimators": 3, "max_depth": 2, "subsample": 1.0})
    seen = []

    def attribute(table):
        out = materialise(explained.attribute(table), "moved")
        seen.append(out)
        return out

    spied = at.Explanation("S1", 42, explained.fitted, explained.background, explained.arrays, attribute)
    found = quality.stage_quality([spied], n_perturbations=2, noise_scale=0.5).collect()
    assert len(found) == 1 and found[0].stage == "S1" and found[0].n_perturbed == 60
    moved = seen[0].collect()
    assert len(moved) == 120
    leaves = at.tree_leaves(explained.fitted.estimator)
    back = np.array([r.x for r in at.model_rows(explained.fitted, explained.background).collect()])
    again = at.leaf_shapley(np.array([r.x for r in moved]), back, leaves)
    assert np.array([r.phi for r in moved]) == pytest.approx(again, abs=1e-9)
    ratios = [np.linalg.norm(p - np.array(r._phi)) / np.linalg.norm(r._noise) for p, r in zip(again, moved)]
    assert found[0].max_lipschitz == pytest.approx(max(ratios)) and max(ratios) > 0
    assert found[0].mean_lipschitz == pytest.approx(np.mean(ratios))
    with pytest.raises(ValueError):
        quality.stage_quality([])


def test_unknown_model_and_params(rows):
    with pytest.raises(models.ModelError):
        models.build_model("svm", seed=1)
    with pytest.raises(models.ModelError):
        models.build_model("gbt", seed=1, params={"nope": 1})
    with pytest.raises(models.ModelError):
        models.fit_model(rows[0], "logreg", ["a"], seed=1, imbalance="magic")


@pytest.mark.parametrize("kind, params", [("logreg", {}), ("random_forest", {"n_estimators": 3, "max_depth": 2})])
def test_a_tagged_session_scores_fitted_models(spark, rows, kind, params):
    spark.addTag("tagged")
    try:
        scored = models.fit_model(rows[0], kind, ["a", "b"], seed=3, params=params).score(rows[0])
        assert scored.select("score").distinct().count() > 1
    finally:
        spark.removeTag("tagged")


def test_tuning_keeps_finished_trials(rows, tmp_path):
    df, _ = rows
    path = str(tmp_path / "trials")
    args = (df, df, "logreg", ["a", "b"])
    first = models.tune(*args, n_trials=2, path=path).collect()
    again = models.tune(*args, n_trials=3, path=path).collect()
    assert [r["params"] for r in again[:2]] == [r["params"] for r in first] and len(again) == 3
    best = models.load_tuned(models.load_trials(df.sparkSession, path), "static_logreg_seed42")
    assert 1e-3 <= best["C"] <= 1e2
    with pytest.raises(FileNotFoundError):
        models.load_tuned(models.load_trials(df.sparkSession, path), "other")


def test_preprocess(spark):
    data = [(float(i), "xyz"[i % 3], None if i % 10 == 0 else f"k{i % 30:02d}") for i in range(300)]
    data += [(None, "rare", None)]
    df = spark.createDataFrame(data, "n double, small string, wide string")
    fit = preprocess.preprocess(df, ["n"], ["small", "wide"], scale=True)
    assert fit.medians["n"] == 149.5
    assert fit.levels["small"] == (["x", "y", "z"], True)  # below one percent
    kept, rare = fit.levels["wide"]
    assert rare and len(kept) == 14
    assert len(fit.names) == 1 + 4 + 15
    row = fit.transform(df.where("small = 'rare'")).first()["features"].toArray()
    assert row[0] == pytest.approx((149.5 - fit.means["n"]) / fit.scales["n"])
    assert row[1:5].tolist() == [0, 0, 0, 1]
    other = spark.createDataFrame([(1.0, "new", "new")], df.schema)
    assert fit.transform(other).first()["features"].toArray()[[4, 19]].tolist() == [1, 1]


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 6, "y int")
    row = preprocess.class_weights(df).first()
    assert (row["weight_pos"], row["neg_per_pos"]) == (2.0, 3.0)
    assert row["weight_neg"] == pytest.approx(8 / 12)
    with pytest.raises(ValueError):
        preprocess.class_weights(df.where("y = 0")).collect()


def test_smote_balances_on_segments(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(130, 3))
    data = [(f"s{i}", int(i < 30), x[i].tolist()) for i in range(130)]
    df = spark.createDataFrame(data, "session_id string, y int, features array<double>")
    out = preprocess.smote_oversample(df, k=3)
    sizes = {(r["y"], r["synthetic"]): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert sizes == {(0, False): 100, (1, False): 30, (1, True): 70}
    small = x[:30]
    for r in out.where("synthetic").limit(20).collect():
        p, base = np.array(r["features"]), x[int(r["session_id"][1:].split("#")[0])]
        gaps = [abs(np.linalg.norm(p - base) + np.linalg.norm(q - p) - np.linalg.norm(q - base)) for q in small]
        assert min(gaps) < 1e-9
    same = out.select("session_id", "features").orderBy("session_id").collect()
    assert same == preprocess.smote_oversample(df.orderBy(F.desc("session_id")), k=3).select(
        "session_id", "features").orderBy("session_id").collect()
    with pytest.raises(ValueError):
        preprocess.smote_oversample(df.limit(3))


def test_near_rows_finds_true_neighbours_mostly(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(200)], "id long, f array<double>")
    got = preprocess.near_rows(df, 3, key="id", features="f", seed=1, projections=4, reach=12)
    hits = 0
    for r in got.collect():
        true = np.argsort(np.linalg.norm(x - x[r["id"]], axis=1))[1:4]
        hits += len({n["k"] for n in r["near"]} & set(true.tolist()))
    assert hits / 600 > 0.9


def test_near_rows_carry_no_vectors_between_projections(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, f array<double>")
    seen, plain = [], preprocess.value_positions
    monkeypatch.setattr(preprocess, "value_positions", lambda d, *a, **k: seen.append(d.columns) or plain(d, *a, **k))
    got = preprocess.near_rows(df, 3, key="id", features="f", seed=1, reach=60)
    assert seen == [["id", "f", "_p"]] * 3
    assert dict(got.dtypes)["near"] == "array<struct<d:double,k:bigint>>"
    for r in got.collect():  # every row is in reach, so the neighbours are the true ones
        d = ((x - x[r["id"]]) ** 2).sum(axis=1)
        assert [n["k"] for n in r["near"]] == np.argsort(d)[1:4].tolist()


# tables -------------------------------------------------------------------------------
def table(spark, shares):
    """Attribution whose mean absolute values are the given numbers."""
    rows = []
    for stage, values in shares.items():
        for f, v in values.items():
            rows += [(stage, f"s{i}", f, float(i), v * (1 if i % 3 else -1)) for i in range(6)]
    return spark.createDataFrame(rows, LONG)


def test_importance_groups_and_migration(spark):
    df = table(spark, {"S1": {"a": 3.0, "b": 1.0}, "S2": {"a": 1.0, "b": 1.0, "c": 2.0}})
    imp = {(r["stage"], r["feature"]): r for r in at.global_importance(df).collect()}
    assert imp["S1", "a"]["share"] == 0.75 and imp["S1", "a"]["rank"] == 1
    groups = spark.createDataFrame([("a", "a+b"), ("b", "a+b"), ("c", "c")], "feature string, `group` string")
    grouped = at.grouped_attribution(df, groups)
    got = {(r["stage"], r["group"]): r for r in grouped.collect()}
    assert got["S2", "a+b"]["mean_abs_shap"] == pytest.approx(2.0) and got["S2", "a+b"]["n_members"] == 2
    moves = {(r["stage"], r["group"]): r for r in at.attribution_migration(grouped).collect()}
    assert len(moves) == 4 and not moves["S1", "c"]["available"]
    assert moves["S2", "a+b"]["share_change"] == pytest.approx(-0.5)
    assert moves["S2", "c"]["share_change"] is None  # no first value: not zero
    assert at.group_members(groups.select("group")).count() == 3


def test_rank_of_equal_features_goes_by_name(spark):
    """Equal values summed in another order differ in the last digit; the name decides all the same."""
    shap = {"a": (0.3, 0.2, 0.1), "b": (0.1, 0.2, 0.3), "c": (0.2, 0.2, 0.1)}
    assert 0.1 + 0.2 + 0.3 > 0.3 + 0.2 + 0.1
    rows = [("S1", f"s{i}", f, 0.0, v) for f, vs in shap.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, LONG).coalesce(1)
    got = {r["feature"]: r["rank"] for r in at.global_importance(df).collect()}
    assert got == {"a": 1, "b": 2, "c": 3}


def test_sign_reversal(spark):
    df = spark.createDataFrame(
        [("S1", "x", "a", 0.0, 1.0), ("S2", "x", "a", 0.0, -1.0)], LONG)
    got = {r["stage"]: r["reversed_sign"] for r in at.migration_table(df, grouped=False).collect()}
    assert got == {"S1": False, "S2": True}


def test_correlation_groups_chain_and_constants(spark):
    rows = []
    for i in range(40):
        for f, v in (("a", i), ("b", -i * 2.0), ("c", i if i else 39), ("k", 1.0), ("z", (i * 17) % 40)):
            rows.append(("S1", f"s{i}", f, float(v), 0.0))
    got = {r["feature"]: r["group"] for r in at.correlation_groups(spark.createDataFrame(rows, LONG), threshold=0.8).collect()}
    assert got == {"a": "a+b+c", "b": "a+b+c", "c": "a+b+c", "k": "k", "z": "z"}


def test_static_contrast(spark):
    rows = [("g", s, v, True) for s, v in (("S1", 0.1), ("S2", 0.5), ("S3", 0.2))] + [
        ("h", "S1", 0.3, True), ("h", "S2", None, False)]
    df = spark.createDataFrame(rows, "`group` string, stage string, share double, available boolean")
    got = at.static_contrast(df).collect()
    assert [r["group"] for r in got] == ["g"]
    assert got[0]["peak_stage"] == "S2" and got[0]["non_monotone"]
    assert got[0]["static_understates_peak_by"] == pytest.approx(0.5 - 0.8 / 3)


def test_aggregate_shares_rejects_disjoint_groups(spark):
    shares = spark.createDataFrame([("n_events", 0.4), ("other", 0.6)], "feature string, share double")
    groups = spark.createDataFrame([("n_events", "g")], "feature string, `group` string")
    got = {r["group"]: r["share"] for r in at.aggregate_shares(shares, groups).collect()}
    assert got == {"g": 0.4, "other": 0.6}
    with pytest.raises(ValueError):
        at.aggregate_shares(shares, groups.withColumn("feature", F.lit("zzz")))


def test_null_table(spark):
    observed = spark.createDataFrame([("S1", "g", 0.5), ("S1", "h", 0.1)], "stage string, `group` string, share double")
    nulls = spark.createDataFrame(
        [(i, "S1", "g", 0.1 * i) for i in range(4)], "round int, stage string, `group` string, share double")
    got = {r["group"]: r for r in at.null_table(observed, nulls).collect()}
    assert got["g"]["p_value"] == 0.2 and got["g"]["null_max"] == 0.3
    assert got["h"]["p_value"] == 0.2 and got["h"]["null_mean"] == 0.0  # missing counts as zero
    with pytest.raises(ValueError):
        at.null_table(observed, nulls.limit(0))


def test_entropy_availability(spark):
    rows = [("S1", f"s{i}", f, float(i % 2) if f == "category_entropy" else 1.0, v)
            for i in range(4) for f, v in (("category_entropy", 1.0 if i % 2 else 0.0), ("x", 1.0))]
    rows += [("S2", "s0", "x", 1.0, 1.0)]
    got = {r["stage"]: r for r in at.entropy_availability(spark.createDataFrame(rows, LONG)).collect()}
    assert got["S1"]["share_prefixes_defined"] == 0.5
    assert got["S1"]["attribution_share_overall"] == pytest.approx(2 / 6, abs=1e-4)
    assert got["S1"]["attribution_share_when_defined"] == 0.5
    assert not got["S2"]["feature_present"]


# quality ------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(9)
    w = np.array([1.2, -0.8, 0.5, 0.1, -0.3, 0.6])
    x, b = rng.normal(size=(400, 6)), rng.normal(size=(60, 6))
    phi = (x - b.mean(axis=0)) * w
    rows = [("S1", f"s{i}", x[i].tolist(), phi[i].tolist()) for i in range(400)]
    back = spark.createDataFrame([(f"b{i:02d}", b[i].tolist()) for i in range(60)], "session_id string, x array<double>")
    df = spark.createDataFrame(rows, "stage string, session_id string, x array<double>, phi array<double>")
    return df, quality.numbered_background(back), quality.linear_predictor(w), w


def test_exact_attributions_are_faithful_and_noise_is_not(linear):
    df, back, predict, _ = linear
    good = quality.faithfulness(df, back, predict).first()
    assert good["passes"] and good["n_instances"] == 400
    shuffled = df.withColumn("phi", F.reverse("phi"))
    assert quality.faithfulness(shuffled, back, predict).first()["correlation_mean"] < good["correlation_mean"] - 0.3


def test_curves(linear):
    df, back, predict, _ = linear
    deletion = quality.deletion_curve(df, back, predict).first()
    insertion = quality.insertion_curve(df, back, predict).first()
    chance = quality.random_curve(df, back, predict).first()
    assert deletion["auc"] < chance["auc"] < insertion["auc"]
    assert deletion["monotone"] and insertion["monotone"]
    points = quality.replacement_curve(df, back, predict, insert=False).orderBy("step").collect()
    start = predict(df).agg(F.avg("p")).first()[0]
    assert len(points) == 11 and points[0]["mean_prediction"] == pytest.approx(start)


def test_lipschitz_of_a_linear_model_is_bounded_by_its_weights(linear):
    df, _, _, w = linear
    weights = F.array(*[F.lit(float(v)) for v in w])

    def explain(rows):
        shift = F.zip_with("_noise", weights, lambda n, c: n * c)
        return rows.withColumn("phi", F.zip_with("_phi", shift, lambda a, b: a + b))

    row = quality.local_lipschitz(df, explain).first()
    assert 0 < row["mean_ratio"] <= row["max_ratio"] <= 1.2 + 1e-9 and row["n_instances"] == 400


def test_rank_consistency(spark):
    rows = [("S1", s, f"g{i}", float(i if s < 3 else -i)) for s in (1, 2, 3) for i in range(5)]
    df = spark.createDataFrame(rows, "stage string, seed int, `group` string, mean_abs_shap double")
    row = quality.rank_consistency(df).first()
    assert row["min_spearman"] == pytest.approx(-1.0) and row["n_pairs"] == 3 and not row["passes"]
    assert row["mean_spearman"] == pytest.approx(-1 / 3)


# agreement -------------------------------------------------------------------------------
def test_per_instance_agreement_joins_on_sessions(spark):
    import random

    ids = [f"s{i}" for i in range(40)]
    left = [("S1", s, "log_price", float(i)) for i, s in enumerate(ids)]
    right = [("S1", s, "log_price", float(i) ** 3) for i, s in enumerate(ids)]
    random.Random(0).shuffle(right)
    a = spark.createDataFrame(left, "stage string, session_id string, concept string, tabular double")
    b = spark.createDataFrame(right, "stage string, session_id string, concept string, sequence double")
    row = sequences.per_instance_agreement(a, b).first()
    assert row["spearman"] == pytest.approx(1.0) and row["n_sessions"] == 40
    assert sequences.per_instance_agreement(a.limit(20), b).count() == 0
    assert sequences.per_instance_agreement(a.withColumn("tabular", F.lit(1.0)), b).count() == 0
    seeds = sequences.per_instance_agreement(a, b).unionByName(
        sequences.per_instance_agreement(a.withColumn("tabular", -F.col("tabular")), b))
    over = sequences.agreement_over_seeds(seeds).first()
    assert over["share_negative"] == 0.5 and not over["sign_consistent"]


def test_align_concepts_drops_unmapped(spark):
    seq = spark.createDataFrame([("S1", f, 1.0) for f in sequences.SEQUENCE_FEATURES],
                                "stage string, feature string, mean_abs double")
    imp = spark.createDataFrame([("S1", "price_mean", 0.2), ("S1", "price_max", 0.3), ("S1", "n_views", 0.1)],
                                "stage string, feature string, mean_abs_shap double")
    got = {r["concept"]: r["tabular"] for r in sequences.align_concepts(seq, imp).collect()}
    assert got == pytest.approx({"log_price": 0.5, "event_type_view": 0.1})
    table = sequences.cross_paradigm(sequences.align_concepts(seq, imp)).first()
    assert table["n_concepts"] == 2 and table["spearman"] is None


def test_permutation_attribution_sees_only_the_used_feature(spark):
    rows = [("S1", f"s{i}", [[float(i % 5), 0.0, 0.0, float(i), 0.0, 0.0, 0.0]]) for i in range(30)]
    df = spark.createDataFrame(rows, "stage string, session_id string, x array<array<double>>")
    predict = lambda t: t.withColumn("p", F.col("x")[0][3] / 30)
    got = {r["feature"]: r["mean_abs"] for r in sequences.permutation_attribution(df, predict, n_repeats=4).collect()}
    assert got["log_gap_s"] > 0.1 and got["event_type_view"] == 0.0


def test_permutation_attribution_by_definition_and_without_broadcasts(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(12, 3, 7)), 2)
    keys = [f"s{i}" for i in range(12)]
    df = spark.createDataFrame([("S1", k, v.tolist()) for k, v in zip(keys, x)], "stage string, session_id string, x array<array<double>>")
    df = materialise(df)
    predict = lambda t: t.withColumn("p", sum((F.col("x")[i][j] * (1 + i + 3 * j) for i in range(3) for j in range(7)), F.lit(0.0)))
    weight = np.array([[1.0 + i + 3 * j for j in range(7)] for i in range(3)])
    want = {}
    for trial in range(14):
        order = [sorted(range(12), key=lambda r: hashlib.md5(f"{keys[r]}|{trial}|42|{side}".encode()).hexdigest()) for side in ("to", "from")]
        j = trial % 7
        for own, other in zip(*order):
            want.setdefault(sequences.SEQUENCE_FEATURES[j], []).append(((x[own] - x[other]) * weight)[:, j].sum())
    table = sequences.permutation_attribution(df, predict, n_repeats=2)
    # the estimated size of exploded rows is that of one trial: a join by broadcast would hold all of them in the driver
    assert "BroadcastExchange" not in table._jdf.queryExecution().executedPlan().toString()
    got = {r["feature"]: (r["mean_abs"], r["mean_signed"]) for r in table.collect()}
    assert set(got) == set(want)
    for f, d in want.items():
        assert got[f] == pytest.approx((np.abs(d).mean(), np.mean(d)))


def test_vector_round_trip(rows):
    df, _ = rows
    fitted = models.fit_model(df, "gbt", ["a", "b"], seed=1, params={"n_estimators": 2, "max_depth": 2})
    matrix = df.select("session_id", F.array("a", "b").alias("x"))
    a = {r[0]: r[1] for r in fitted.score_matrix(matrix).select("session_id", "prediction_score").collect()}
    b = {r[0]: r[1] for r in fitted.score(df).select("session_id", "score").collect()}
    assert a == pytest.approx(b)
    assert array_to_vector is not None


def test_permutation_null_query_takes_all_stages_and_rounds(monkeypatch):
    import inspect

    from wayfare.operators.stages import MODEL_STAGES
    from wayfare.plans import attribution_queries as queries
    from wayfare.plans.artefacts import Artefacts

    calls, real = [], {n: inspect.signature(getattr(queries.at, n)) for n in ("permutation_null", "explain_stages")}
    monkeypatch.setattr(Artefacts, "__init__", lambda self, spark, folder: None)
    monkeypatch.setattr(Artefacts, "features", None)
    monkeypatch.setattr(Artefacts, "split", None)
    monkeypatch.setattr(queries.at, "permutation_null", lambda *a, **o: calls.append(o) or (None, None))
    monkeypatch.setattr(queries.at, "null_table", lambda *a: None)
    queries.query.__globals__["QUERIES"]["permutation_null"](None, "")
    assert calls[0].get("n_rounds", real["permutation_null"].parameters["n_rounds"].default) == 20
    assert calls[0].get("stages", real["explain_stages"].parameters["stages"].default) == MODEL_STAGES


@pytest.mark.parametrize("rows_per_chunk", [7, 40, 10**6])
def test_mid_ranks_of_groups(spark, rows_per_chunk):
    """Ties, a value that most rows of a group share, nulls and a constant group, whatever the chunks."""
    rng = np.random.default_rng(8)
    rows = [("a", int(i), float(v), float(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 9, 150), rng.normal(size=150)))]
    rows += [("b", i, 0.0 if i % 3 else float(i), 1.0) for i in range(90)] + [("c", i, None, float(-i)) for i in range(5)]
    table = spark.createDataFrame(rows, "g string, i int, v double, w double")
    got = ranks.mid_ranks(table, {"v": "rv", "w": "rw"}, ["g"], rows_per_chunk=rows_per_chunk).toPandas()
    want = pd.DataFrame(rows, columns=["g", "i", "v", "w"]).assign(v=lambda t: t.v.fillna(-1.0))
    want["rv"], want["rw"] = (want.groupby("g")[c].rank() for c in ("v", "w"))
    both = got.merge(want[["g", "i", "rv", "rw"]], on=["g", "i"], suffixes=("", "_want"))
    assert len(both) == len(got) == len(rows) and list(got.columns) == ["g", "i", "v", "w", "rv", "rw"]
    assert (both.rv == both.rv_want).all() and (both.rw == both.rw_want).all()


def test_rank_correlations_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    wide = pd.DataFrame(rng.integers(0, 12, (200, 5)).astype(float), columns=list("vwxyz")).assign(z=3.0)
    rows = [(s, f"s{i}", f, float(v), 0.0) for s in ("S1", "S2") for i, r in wide.iterrows() for f, v in r.items()]
    rho = wide.corr(method="spearman")
    for chunk in (30, 10**6):
        got = at.rank_correlations(spark.createDataFrame(rows, LONG), rows_per_chunk=chunk).collect()
        assert len(got) == 2 * 10
        for r in got:
            assert r.rho is None if "z" in (r.a, r.b) else r.rho == pytest.approx(rho.loc[r.a, r.b])
