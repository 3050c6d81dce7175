"""Queries over attribution tables, their quality, and sequences.

Table operators run on the exact attributions of a fixed linear score, which
the comparison SQL can recompute; the fitted models have queries of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution as at
from ..operators import quality, sequences
from ..operators.features import ALL_FEATURES, feature_names, whole_session_features
from ..operators.metrics import ranking_metrics, threshold_counts
from ..operators.models import beside
from ..operators.stages import MODEL_STAGES, stage_prefixes
from ..session import materialise
from .artefacts import SEEDS, Artefacts
from .model_queries import SMALL
from .registry import query, r, rnd, rounded
from .sql_text import cte


def unit(name: str) -> float:
    return 1e-5 if name.endswith("_s") else 0.01 if name in ("price_mean", "price_max", "hour_of_day") else 0.2


def weights(stage: str, seed: int) -> dict[str, float]:
    """The fixed linear score: small half-integers in the unit of each feature."""
    return {
        f: unit(f) * ((ALL_FEATURES.index(f) * 7 + seed) % 5 - 1.5) for f in feature_names(stage)
    }


def _parts(a: Artefacts, stage: str, table=None):
    rows = (a.features.where(F.col("stage") == stage) if table is None else table).join(
        a.split.select("session_id", "partition"), "session_id")
    columns = ["session_id", *feature_names("S3" if stage == "W" else stage)]
    train = rows.where(F.col("partition") == "train").select(columns)
    val = rows.where(F.col("partition") == "val").select(columns)
    return val, train


def attributions(a: Artefacts):
    """Linear attributions of every stage and seed."""
    def build():
        out = None
        for stage in MODEL_STAGES:
            explain, background = _parts(a, stage)
            for seed in SEEDS:
                part = at.linear_attribution(explain, background, weights(stage, seed)).select(
                    F.lit(stage).alias("stage"), F.lit(seed).alias("seed"), "*")
                out = part if out is None else out.unionByName(part)
        return out

    return a.table("attributions", build)


def first_seed(a: Artefacts):
    return attributions(a).where(F.col("seed") == 42).drop("seed")


def groups_of(a: Artefacts):
    return a.table("groups", lambda: at.correlation_groups(first_seed(a)))


def reference(a: Artefacts):
    return at.reference_groups(groups_of(a))


_NAMES = list(ALL_FEATURES)
_LATER = [f for f in _NAMES if f not in feature_names("S1")]
_COLS = ", ".join(f'"{c}"' for c in _NAMES)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_WEIGHT = (f"(CASE WHEN feature LIKE '%\\_s' ESCAPE '\\' THEN 1e-5 WHEN feature IN ('price_mean', 'price_max', 'hour_of_day') "
           f"THEN 0.01e0 ELSE 0.2e0 END * (((list_position({_NAMES!r}, feature) - 1) * 7 + seed) % 5 - 1.5e0))")
cte("a_cells", f"""
    SELECT session_id, stage, feature, v FROM (
      UNPIVOT (SELECT session_id, stage, {_COLS} FROM j_feats) ON {_COLS} INTO NAME feature VALUE v)
    WHERE NOT (stage = 'S1' AND feature IN {_in(_LATER)})""")
cte("a_back", """
    SELECT f.session_id, stage FROM j_feats f JOIN j_split p ON f.session_id = p.session_id
    WHERE "partition" = 'train'""")
cte("a_means", """
    SELECT c.stage, feature, avg(v) AS mean FROM a_cells c JOIN a_back b ON c.stage = b.stage AND c.session_id = b.session_id
    GROUP BY 1, 2""")
cte("a_attr", f"""
    SELECT c.stage, seed, c.session_id, c.feature, v AS "value", {_WEIGHT.replace('feature', 'c.feature')} * (v - mean) AS shap
    FROM a_cells c JOIN a_means m ON c.stage = m.stage AND c.feature = m.feature
    JOIN j_split p ON c.session_id = p.session_id AND "partition" = 'val', (VALUES (42), (43), (44), (45), (46)) AS s(seed)""")
cte("a_one", "SELECT * FROM a_attr WHERE seed = 42")
cte("a_imp", """
    SELECT *, mean_abs_shap / sum(mean_abs_shap) OVER (PARTITION BY stage, seed) AS share,
      row_number() OVER (PARTITION BY stage, seed ORDER BY mean_abs_shap DESC, feature) AS "rank"
    FROM (SELECT stage, seed, feature, avg(abs(shap)) AS mean_abs_shap, avg(shap) AS mean_signed_shap FROM a_attr GROUP BY 1, 2, 3)""")
cte("a_ranks", """
    SELECT stage, session_id, feature, rank() OVER (PARTITION BY stage, feature ORDER BY "value")
      + (count(*) OVER (PARTITION BY stage, feature, "value") - 1) / 2 AS rk FROM a_one""")
cte("a_rho", """
    SELECT a.stage, a.feature AS a, b.feature AS b, corr(a.rk, b.rk) AS rho FROM a_ranks a
    JOIN a_ranks b ON a.stage = b.stage AND a.session_id = b.session_id AND a.feature <> b.feature GROUP BY 1, 2, 3""")
cte("a_links", "SELECT stage, a, b FROM a_rho WHERE rho IS NOT NULL AND NOT isnan(rho) AND abs(rho) >= 0.95")
cte("a_reach", """
    SELECT DISTINCT stage, feature AS a, feature AS b FROM a_one UNION
    SELECT a_reach.stage, a_reach.a, l.b FROM a_reach JOIN a_links l ON a_reach.stage = l.stage AND a_reach.b = l.a""")
cte("a_groups", """
    SELECT stage, a AS feature, string_agg(b, '+' ORDER BY b) AS "group" FROM a_reach GROUP BY 1, 2""")
cte("a_ref", "SELECT feature, \"group\" FROM a_groups WHERE stage = 'S1'")
cte("a_grouped", """
    SELECT *, mean_abs_shap / sum(mean_abs_shap) OVER (PARTITION BY stage, seed) AS share,
      row_number() OVER (PARTITION BY stage, seed ORDER BY mean_abs_shap DESC, "group") AS "rank"
    FROM (SELECT stage, seed, "group", count(*) AS n_members, sum(mean_abs_shap) AS mean_abs_shap,
        sum(mean_signed_shap) AS mean_signed_shap FROM a_imp JOIN a_ref USING (feature) GROUP BY 1, 2, 3)""")
cte("a_grid", """
    SELECT g."group", s.stage, n_members, mean_abs_shap, mean_signed_shap, share, "rank", m.stage IS NOT NULL AS available
    FROM (SELECT DISTINCT "group" FROM a_grouped WHERE seed = 42) g, (SELECT DISTINCT stage FROM a_grouped) s
    LEFT JOIN (SELECT * FROM a_grouped WHERE seed = 42) m ON m."group" = g."group" AND m.stage = s.stage""")
_MOVES = """share - first_value(share) OVER w AS share_change,
      CAST("rank" - first_value("rank") OVER w AS INT) AS rank_change,
      sign(mean_signed_shap) <> sign(first_value(mean_signed_shap) OVER w) AS reversed_sign"""
cte("a_migration", f"""SELECT *, {_MOVES} FROM a_grid WINDOW w AS (PARTITION BY "group" ORDER BY stage)""")
cte("a_plain_grid", """
    SELECT g.feature AS "group", s.stage, CASE WHEN m.stage IS NOT NULL THEN 1 END AS n_members, mean_abs_shap,
      mean_signed_shap, share, "rank", m.stage IS NOT NULL AS available
    FROM (SELECT DISTINCT feature FROM a_imp) g, (SELECT DISTINCT stage FROM a_imp) s
    LEFT JOIN (SELECT * FROM a_imp WHERE seed = 42) m ON m.feature = g.feature AND m.stage = s.stage""")
cte("a_plain", f"""SELECT *, {_MOVES} FROM a_plain_grid WINDOW w AS (PARTITION BY "group" ORDER BY stage)""")

_IMP = ("mean_abs_shap", "mean_signed_shap", "share")


@query("stage_attribution", f"""SELECT stage, seed, session_id, feature, {r('value', 'shap', digits=5)} FROM a_attr""")
def _(a: Artefacts):
    out = None
    for stage in MODEL_STAGES:
        explain, background = _parts(a, stage)
        for seed in SEEDS:
            part = at.linear_attribution(explain, background, weights(stage, seed)).select(
                F.lit(stage).alias("stage"), F.lit(seed).alias("seed"), "*")
            out = part if out is None else out.unionByName(part)
    return rounded(out, 5)


@query("global_importance", f"""
    SELECT stage, feature, {r(*_IMP, digits=5)}, CAST("rank" AS INT) AS "rank" FROM a_imp WHERE seed = 42""")
def _(a: Artefacts):
    return rounded(at.global_importance(first_seed(a)), 5)


@query("correlation_groups", 'SELECT stage, feature, "group" FROM a_groups')
def _(a: Artefacts):
    return at.correlation_groups(first_seed(a))


@query("reference_groups", 'SELECT feature, "group" FROM a_ref')
def _(a: Artefacts):
    return reference(a)


@query("group_members", 'SELECT feature, "group" FROM a_ref')
def _(a: Artefacts):
    return at.group_members(reference(a).select("group"))


_GROUPED = f"""
    SELECT stage, "group", n_members, {r(*_IMP, digits=5)}, CAST("rank" AS INT) AS "rank" FROM a_grouped WHERE seed = 42"""


@query("grouped_attribution", _GROUPED)
def _(a: Artefacts):
    return rounded(at.grouped_attribution(first_seed(a), reference(a)), 5)


@query("stage_importance", _GROUPED)
def _(a: Artefacts):
    parts = [at.grouped_attribution(first_seed(a).where(F.col("stage") == s), reference(a)) for s in MODEL_STAGES]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 5)


def _migration(table: str) -> str:
    return f"""SELECT "group", stage, CAST(n_members AS BIGINT) AS n_members, {r(*_IMP, digits=5)}, CAST("rank" AS INT) AS "rank",
      available, {rnd('share_change', 5)} AS share_change, rank_change, reversed_sign FROM {table}"""


@query("attribution_migration", _migration("a_migration"))
def _(a: Artefacts):
    return rounded(at.attribution_migration(at.grouped_attribution(first_seed(a), reference(a))), 5)


@query("migration_table", _migration("a_plain"))
def _(a: Artefacts):
    return rounded(at.migration_table(first_seed(a), grouped=False), 5)


cte("a_static", """
    SELECT "group", avg(share) AS static_share, max(share) - min(share) AS range_share, max(share) AS peak_share,
      arg_max(stage, share) AS peak_stage, arg_min(stage, share) AS trough_stage, min(stage) AS lo, max(stage) AS hi,
      count(*) AS n_stages FROM (SELECT * FROM a_migration WHERE available ORDER BY stage) GROUP BY 1 HAVING count(*) >= 2""")


@query("static_contrast", f"""
    SELECT "group", {r('static_share', 'range_share', 'peak_share', digits=5)}, peak_stage, trough_stage,
      (peak_stage > lo AND peak_stage < hi) OR (trough_stage > lo AND trough_stage < hi) AS non_monotone,
      {rnd('peak_share - static_share', 5)} AS static_understates_peak_by, n_stages FROM a_static""")
def _(a: Artefacts):
    migration = at.attribution_migration(at.grouped_attribution(first_seed(a), reference(a)))
    return rounded(at.static_contrast(migration), 5)


# whole sessions ---------------------------------------------------------------------
cte("b_cells", f"""
    UNPIVOT (SELECT session_id, {_COLS} FROM k_feats) ON {_COLS} INTO NAME feature VALUE v""")
cte("b_back", """
    SELECT f.session_id FROM k_feats f JOIN j_split p ON f.session_id = p.session_id WHERE "partition" = 'train'""")
cte("b_means", "SELECT feature, avg(v) AS mean FROM b_cells WHERE session_id IN (SELECT session_id FROM b_back) GROUP BY 1")
cte("b_imp", f"""
    SELECT c.feature, avg(abs({_WEIGHT.replace('feature', 'c.feature').replace('seed', '42')} * (v - mean))) AS m
    FROM b_cells c JOIN b_means m ON c.feature = m.feature JOIN j_split p ON c.session_id = p.session_id AND "partition" = 'val' GROUP BY 1""")
_ABLATION = "CASE " + " ".join(f"WHEN feature IN {_in(v)} THEN '{k}'" for k, v in {
    "baseline_aggregate": ("n_events", "n_views"), "temporal": ("inter_event_std_s",),
    "composite": ("purchase_intent_score",)}.items()) + " ELSE feature END"
cte("b_shares", f"""
    SELECT coalesce("group", {_ABLATION}) AS "group", sum(m) / (SELECT sum(m) FROM b_imp) AS share
    FROM b_imp LEFT JOIN a_ref USING (feature) GROUP BY 1""")


def whole_shares(a: Artefacts):
    def build():
        table = materialise(whole_session_features(a.sessions, exclude_purchase=True), "whole")
        explain, background = _parts(a, "W", table)
        attr = at.linear_attribution(explain, background, weights("S3", 42)).withColumn("stage", F.lit("W"))
        return at.aggregate_shares(at.global_importance(attr).select("feature", "share"), reference(a))

    return a.table("whole_shares", build)


@query("aggregate_shares", f'SELECT "group", {rnd("share", 5)} AS share FROM b_shares')
def _(a: Artefacts):
    return rounded(whole_shares(a), 5)


cte("b_contrast", """
    SELECT "group", max(share) FILTER (stage = 'S1') AS "share_S1", max(share) FILTER (stage = 'S2') AS "share_S2",
      max(share) FILTER (stage = 'S3') AS "share_S3", max(share) AS stage_peak, arg_max(stage, share) AS stage_peak_at
    FROM (SELECT * FROM a_grouped WHERE seed = 42 ORDER BY stage) GROUP BY 1""")


@query("contrast_table", f"""
    SELECT c."group", {r('share_S1', 'share_S2', 'share_S3', 'stage_peak', digits=5)}, stage_peak_at,
      {rnd('coalesce(share, 0)', 5)} AS whole_session_share, {rnd('stage_peak - coalesce(share, 0)', 5)} AS flattening
    FROM b_contrast c LEFT JOIN b_shares w ON c."group" = w."group" """)
def _(a: Artefacts):
    return rounded(at.contrast_table(at.grouped_attribution(first_seed(a), reference(a)), whole_shares(a)), 5)


@query("whole_session_contrast")
def _(a: Artefacts):
    table = whole_session_features(a.sessions, exclude_purchase=True).join(
        a.split.select("session_id", "partition"), "session_id").withColumn("y", F.col("label").cast("int"))
    rows = materialise(table, "whole_rows")
    found = at.explain_rows(rows, feature_names("S3"), stage="W", model="gbt", params=SMALL["gbt"])
    test = found.fitted.score(rows.where(F.col("partition") == "test")).select("y", "score")
    scored = ranking_metrics(threshold_counts(test)).select("n", "prevalence", "pr_auc", "roc_auc")
    shares = at.aggregate_shares(at.global_importance(found.long()).select("feature", "share"), reference(a))
    return rounded(shares.crossJoin(F.broadcast(scored)))  # one row


# permutation null -----------------------------------------------------------------------
def _as_rounds(a: Artefacts):
    return attributions(a).where(F.col("seed") > 42).withColumn("round", F.col("seed") - 43)


@query("null_shares", f"""SELECT CAST(seed - 43 AS INT) AS "round", stage, "group", {rnd('share', 5)} AS share FROM a_grouped WHERE seed > 42""")
def _(a: Artefacts):
    return rounded(at.null_shares(_as_rounds(a), reference(a)), 5)


@query("null_table", f"""
    SELECT o.stage, o."group", {rnd('avg(n.share)', 4)} AS null_mean, {rnd('stddev_samp(n.share)', 4)} AS null_sd,
      {rnd('max(n.share)', 4)} AS null_max, {rnd('(count(*) FILTER (n.share >= o.share) + 1) / 5.0e0', 4)} AS p_value,
      count(*) AS n_rounds, {rnd('o.share', 4)} AS observed_share
    FROM a_grouped o JOIN a_grouped n ON o.stage = n.stage AND o."group" = n."group" AND o.seed = 42 AND n.seed > 42
    GROUP BY o.stage, o."group", o.share""")
def _(a: Artefacts):
    observed = at.grouped_attribution(first_seed(a), reference(a)).select("stage", "group", "share")
    return rounded(at.null_table(observed, at.null_shares(_as_rounds(a), reference(a))), 4)


@query("permutation_null")
def _(a: Artefacts):
    # Every stage and the operator's 20 rounds; a linear model keeps the 63 fits short.
    observed, nulls = at.permutation_null(a.features, a.split, model="logreg")
    return at.null_table(observed, nulls)


def explanations(a: Artefacts, seed: int = 42):
    key = (a.spark.sparkContext.applicationId, a.folder, seed)
    if key not in _EXPLAINED:
        _EXPLAINED[key] = at.explain_stages(a.features, a.split, model="gbt", seed=seed)
    return _EXPLAINED[key]


_EXPLAINED: dict = {}


def explained_long(a: Artefacts, seed: int = 42):
    out = None
    for e in explanations(a, seed).values():
        out = e.long() if out is None else out.unionByName(e.long())
    return out


@query("explain_stages")
def _(a: Artefacts):
    return rounded(explained_long(a))


@query("entropy_availability", f"""
    SELECT stage, true AS feature_present, count(*) FILTER (feature = 'category_entropy') AS n_explained,
      {rnd("avg(CAST(\"value\" > 0 AS INT)) FILTER (feature = 'category_entropy')", 4)} AS share_prefixes_defined,
      {rnd("sum(abs(shap)) FILTER (feature = 'category_entropy') / sum(abs(shap))", 4)} AS attribution_share_overall,
      {rnd("sum(abs(shap)) FILTER (feature = 'category_entropy' AND ok) / sum(abs(shap)) FILTER (ok)", 4)} AS attribution_share_when_defined
    FROM (SELECT *, max(CASE WHEN feature = 'category_entropy' THEN "value" END) OVER (PARTITION BY stage, session_id) > 0 AS ok FROM a_one)
    GROUP BY 1""")
def _(a: Artefacts):
    return rounded(at.entropy_availability(first_seed(a)), 4)


cte("a_top", "SELECT stage, feature, CAST(\"rank\" AS INT) AS \"rank\" FROM a_imp WHERE seed = 42")


@query("beeswarm_points", f"""
    SELECT stage, feature, "rank", session_id, {rnd('shap', 5)} AS shap, {rnd('place / greatest(n - 1, 1)', 5)} AS value_rank FROM (
      SELECT stage, feature, t."rank", session_id, shap, count(*) OVER (PARTITION BY stage, feature) AS n,
        row_number() OVER (PARTITION BY stage, feature ORDER BY round("value", 9), session_id) - 1 AS place
      FROM a_one JOIN a_top t USING (stage, feature) WHERE t."rank" <= 12)""")
def _(a: Artefacts):
    table = first_seed(a).withColumn("value", F.round("value", 9))
    return rounded(at.beeswarm_points(table), 5)


@query("dependence_points", f"""
    SELECT stage, feature, t."rank", session_id, {r('value', 'shap', digits=5)}
    FROM a_one JOIN a_top t USING (stage, feature) WHERE t."rank" <= 3""")
def _(a: Artefacts):
    return rounded(at.dependence_points(first_seed(a)), 5)


@query("feature_peak_importance", f"""
    SELECT feature, {rnd('max(mean_abs_shap)', 5)} AS peak FROM a_imp WHERE seed = 42 GROUP BY 1
    ORDER BY max(mean_abs_shap) DESC, feature LIMIT 15""")
def _(a: Artefacts):
    return rounded(at.feature_peak_importance(first_seed(a)), 5)


# quality ------------------------------------------------------------------------------
def arrays(a: Artefacts, stage: str):
    """Explained rows and numbered background of one stage, as arrays in feature order."""
    explain, background = _parts(a, stage)
    names = feature_names(stage)
    w = weights(stage, 42)
    mean = background.agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
    x = F.array(*[F.col(c) for c in names])
    rows = explain.crossJoin(F.broadcast(mean)).select(
        F.lit(stage).alias("stage"), "session_id", x.alias("x"),
        F.array(*[F.lit(w[c]) * (F.col(c) - F.col(f"_m_{c}")) for c in names]).alias("phi"))
    return (a.table(f"rows_{stage}", lambda: rows),
            a.table(f"back_{stage}", lambda: quality.numbered_background(background.select("session_id", x.alias("x")))))


def per_stage(a: Artefacts, run):
    out = None
    for stage in MODEL_STAGES:
        rows, background = arrays(a, stage)
        predict = quality.linear_predictor(list(weights(stage, 42).values()))
        part = run(stage, rows, background, predict)
        out = part if out is None else out.unionByName(part)
    return out


# long form of the same: position of each feature inside its stage, 0-based
cte("q_cells", """
    SELECT c.*, row_number() OVER (PARTITION BY c.stage, c.session_id ORDER BY list_position(%r, feature)) - 1 AS i,
      %s AS w FROM a_cells c""" % (_NAMES, _WEIGHT.replace("seed", "42")))
cte("q_back", """
    SELECT b.stage, no, i, v FROM q_cells c JOIN (SELECT stage, session_id,
      row_number() OVER (PARTITION BY stage ORDER BY md5(session_id || '|bg'), session_id) - 1 AS no FROM a_back) b
    ON c.stage = b.stage AND c.session_id = b.session_id""")
cte("q_size", "SELECT stage, max(no) + 1 AS size FROM q_back GROUP BY 1")
cte("q_rows", """
    SELECT c.stage, c.session_id, c.i, c.v, c.w, o.shap, count(*) OVER (PARTITION BY c.stage, c.session_id) AS n
    FROM q_cells c JOIN a_one o ON c.stage = o.stage AND c.session_id = o.session_id AND c.feature = o.feature""")
cte("q_draws", """
    SELECT r.*, s, row_number() OVER (PARTITION BY r.stage, session_id, s ORDER BY md5(session_id || '|' || s || '|42|' || i))
      <= greatest(1, floor(n / 4)) AS picked,
      CAST('0x' || substr(md5(session_id || '|' || s || '|42|bg'), 1, 8) AS BIGINT) % size AS no
    FROM q_rows r JOIN q_size z ON r.stage = z.stage, range(0, 50) AS t(s)""")
cte("q_moved", """
    SELECT d.stage, session_id, s, sum(shap) FILTER (picked) AS total,
      1 / (1 + exp(-sum(d.w * d.v))) - 1 / (1 + exp(-sum(d.w * CASE WHEN picked THEN b.v ELSE d.v END))) AS fall
    FROM q_draws d JOIN q_back b ON d.stage = b.stage AND d.no = b.no AND d.i = b.i GROUP BY 1, 2, 3""")
cte("q_corr", """
    SELECT stage, session_id, corr(total, fall) AS r FROM q_moved GROUP BY 1, 2
    HAVING stddev_pop(total) >= 1e-12 AND stddev_pop(fall) >= 1e-12""")


@query("faithfulness", f"""
    SELECT stage, {rnd('avg(r)', 5)} AS correlation_mean, {rnd('coalesce(stddev_samp(r), 0)', 5)} AS correlation_std,
      count(*) AS n_instances, 50 AS n_subsets, avg(r) > 0.5 AS passes FROM q_corr GROUP BY 1""")
def _(a: Artefacts):
    return rounded(per_stage(a, lambda s, rows, back, p: quality.faithfulness(rows, back, p)), 5)


cte("q_ordered", """
    SELECT r.*, row_number() OVER (PARTITION BY r.stage, session_id ORDER BY shap DESC, i) AS place,
      CAST('0x' || substr(md5(session_id || '|0|42|base'), 1, 8) AS BIGINT) % size AS no
    FROM q_rows r JOIN q_size z ON r.stage = z.stage""")
cte("q_stepped", """
    SELECT o.*, b.v AS bv, step, step / 10 AS fraction, round_even(step / 10.0e0 * n, 0) AS k,
      round_even(greatest(step - 1, 0) / 10.0e0 * n, 0) AS k0
    FROM q_ordered o JOIN q_back b ON o.stage = b.stage AND o.no = b.no AND o.i = b.i, range(0, 11) AS t(step)""")


def _curve(name: str, insert: bool) -> str:
    first, rest = ("v", "bv") if insert else ("bv", "v")
    wrong = "-d" if insert else "d"
    cte(f"q_{name}_points", f"""
        SELECT stage, step, max(fraction) AS fraction, avg(p) AS mean_prediction, coalesce(avg(phi), 0) AS phi FROM (
          SELECT stage, session_id, step, max(fraction) AS fraction,
            1 / (1 + exp(-sum(w * CASE WHEN place <= k THEN {first} ELSE {rest} END))) AS p,
            avg(shap) FILTER (place > k0 AND place <= k) AS phi FROM q_stepped GROUP BY 1, 2, 3) GROUP BY 1, 2""")
    cte(f"q_{name}_moves", f"""
        SELECT *, mean_prediction - lag(mean_prediction) OVER w AS d,
          (mean_prediction + lag(mean_prediction) OVER w) / 2 * (fraction - lag(fraction) OVER w) AS area
        FROM q_{name}_points WINDOW w AS (PARTITION BY stage ORDER BY step)""")
    cte(f"q_{name}_sum", f"""
        SELECT stage, sum(area) AS auc, coalesce(greatest(0, max({wrong}) FILTER (step > 0 AND phi > 0))
          / nullif(max(mean_prediction) - min(mean_prediction), 0), 0) AS max_violation FROM q_{name}_moves GROUP BY 1""")
    return f"""SELECT stage, {rnd('auc')} AS auc, max_violation <= 0.02 AS monotone, {rnd('max_violation', 5)} AS max_violation
        FROM q_{name}_sum"""


def _rounded_curve(df):
    return rounded(df.withColumn("max_violation", F.round(F.col("max_violation") + 1e-9, 5)))


@query("deletion_curve", _curve("deletion", False))
def _(a: Artefacts):
    return _rounded_curve(per_stage(a, lambda s, rows, back, p: quality.deletion_curve(rows, back, p)))


@query("insertion_curve", _curve("insertion", True))
def _(a: Artefacts):
    return _rounded_curve(per_stage(a, lambda s, rows, back, p: quality.insertion_curve(rows, back, p)))


cte("q_shuffled", """
    SELECT r.*, draw, row_number() OVER (PARTITION BY r.stage, session_id, draw
        ORDER BY md5(session_id || '|' || draw || '|42|order|' || i)) AS place,
      CAST('0x' || substr(md5(session_id || '|' || draw || '|42|base'), 1, 8) AS BIGINT) % size AS no
    FROM q_rows r JOIN q_size z ON r.stage = z.stage, range(0, 5) AS t(draw)""")
cte("q_random", """
    SELECT stage, step, avg(p) AS p FROM (
      SELECT o.stage, session_id, draw, step, 1 / (1 + exp(-sum(w * CASE WHEN place <= round_even(step / 10.0e0 * n, 0)
        THEN b.v ELSE o.v END))) AS p
      FROM q_shuffled o JOIN q_back b ON o.stage = b.stage AND o.no = b.no AND o.i = b.i, range(0, 11) AS t(step)
      GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""")


@query("random_curve", f"""
    SELECT stage, {rnd('sum(area)')} AS auc FROM (
      SELECT stage, (p + lag(p) OVER (PARTITION BY stage ORDER BY step)) / 2 * 0.1e0 AS area FROM q_random) GROUP BY 1""")
def _(a: Artefacts):
    return rounded(per_stage(a, lambda s, rows, back, p: quality.random_curve(rows, back, p)))


def _linear_phi(stage):
    w = F.array(*[F.lit(v) for v in weights(stage, 42).values()])
    return lambda df: df.withColumn("phi", F.zip_with(
        F.zip_with(F.zip_with("x", "_noise", lambda a, b: b), w, lambda n, c: n * c), F.col("_phi"), lambda a, b: a + b))


cte("q_noise", """
    SELECT stage, session_id, draw, w, (CASE WHEN sd > 0 THEN sd ELSE 1 END) * 0.05e0
      * sqrt(-2 * ln((CAST('0x' || substr(md5(session_id || '|' || draw || '|' || i || '|42|a'), 1, 8) AS BIGINT) + 0.5e0) / 4294967296.0e0))
      * cos(2 * pi() * (CAST('0x' || substr(md5(session_id || '|' || draw || '|' || i || '|42|b'), 1, 8) AS BIGINT) + 0.5e0) / 4294967296.0e0) AS e
    FROM (SELECT *, stddev_pop(v) OVER (PARTITION BY stage, i) AS sd FROM q_rows), range(0, 5) AS t(draw)""")


@query("local_lipschitz", f"""
    SELECT stage, {rnd('max(ratio)')} AS max_ratio, {rnd('avg(ratio)')} AS mean_ratio, count(DISTINCT session_id) AS n_instances,
      0.05e0 AS noise_scale
    FROM (SELECT stage, session_id, draw, sqrt(sum(w * e * w * e)) / sqrt(sum(e * e)) AS ratio FROM q_noise GROUP BY 1, 2, 3) GROUP BY 1""")
def _(a: Artefacts):
    return rounded(per_stage(a, lambda s, rows, back, p: quality.local_lipschitz(rows, _linear_phi(s))))


cte("r_ranks", """
    SELECT stage, seed, "group", rank() OVER (PARTITION BY stage, seed ORDER BY mean_abs_shap)
      + (count(*) OVER (PARTITION BY stage, seed, mean_abs_shap) - 1) / 2 AS rk FROM a_grouped""")
cte("r_pairs", """
    SELECT a.stage, a.seed, b.seed AS other, corr(a.rk, b.rk) AS rho FROM r_ranks a
    JOIN r_ranks b ON a.stage = b.stage AND a."group" = b."group" AND a.seed < b.seed GROUP BY 1, 2, 3""")
_CONSISTENT = f"""
    SELECT stage, {rnd('avg(rho)')} AS mean_spearman, {rnd('min(rho)')} AS min_spearman, count(*) AS n_pairs,
      0.6e0 AS threshold, avg(rho) > 0.6 AS passes FROM r_pairs GROUP BY 1"""


@query("rank_consistency", _CONSISTENT)
def _(a: Artefacts):
    grouped = at.grouped_attribution(attributions(a), reference(a), ("stage", "seed"))
    return rounded(quality.rank_consistency(grouped))


@query("seed_consistency")
def _(a: Artefacts):
    beside(a.spark, lambda seed: explanations(a, seed), SEEDS, a.features.count())
    long = reduce(DataFrame.unionByName, [explained_long(a, seed) for seed in SEEDS])
    groups = at.reference_groups(at.correlation_groups(explained_long(a, 42)))
    return rounded(quality.rank_consistency(at.grouped_attribution(long, groups, ("stage", "seed"))))


@query("stage_quality")
def _(a: Artefacts):
    return rounded(quality.stage_quality(explanations(a).values()))


# sequences --------------------------------------------------------------------------------
cte("s_steps", """
    SELECT *, row_number() OVER (PARTITION BY stage, session_id, product_id ORDER BY event_idx) = 1 AS new_product,
      row_number() OVER (PARTITION BY stage, session_id, category_id ORDER BY event_idx) = 1 AS new_category,
      coalesce(floor((epoch_us(event_time) - lag(epoch_us(event_time)) OVER w) / 1e6), 0) AS gap,
      row_number() OVER (PARTITION BY stage, session_id ORDER BY event_idx DESC) AS tail
    FROM j_prefix WINDOW w AS (PARTITION BY stage, session_id ORDER BY event_idx)""")


@query("build_sequences", f"""
    SELECT stage, session_id, bool_or(label) AS label, CAST(least(count(*), 32) AS INT) AS n_steps,
      {rnd("sum(CASE WHEN event_type = 'view' THEN 1.0e0 ELSE 0 END)", 3)} AS views,
      {rnd('sum(CAST(CAST(ln(1 + greatest(gap, 0)) AS FLOAT) AS DOUBLE))', 3)} AS log_gaps, {rnd('sum(CAST(CAST(ln(1 + greatest(price, 0)) AS FLOAT) AS DOUBLE))', 3)} AS log_prices,
      {rnd('sum(CAST(new_product AS INT) * 1.0e0)', 3)} AS new_products, {rnd('sum(CAST(new_category AS INT) * 1.0e0)', 3)} AS new_categories,
      {rnd('arg_max(ln(1 + greatest(price, 0)), event_idx)', 3)} AS last_log_price
    FROM s_steps WHERE tail <= 32 GROUP BY 1, 2""")
def _(a: Artefacts):
    seq = sequences.build_sequences(stage_prefixes(a.sessions), keys=("stage", "session_id"))
    total = lambda j: F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v[j].cast("double"))
    return rounded(seq.select(
        "stage", "session_id", "label", "n_steps", total(0).alias("views"), total(3).alias("log_gaps"),
        total(4).alias("log_prices"), total(5).alias("new_products"), total(6).alias("new_categories"),
        F.get("x", F.col("n_steps") - 1)[4].cast("double").alias("last_log_price")), 3)


def sequence_rows(a: Artefacts):
    return a.table("sequences", lambda: sequences.build_sequences(
        stage_prefixes(a.sessions), keys=("stage", "session_id")).join(
        a.split.select("session_id", "partition"), "session_id"))


def sequence_models(a: Artefacts):
    key = (a.spark.sparkContext.applicationId, a.folder)
    if key not in _SEQUENCE:
        rows = sequence_rows(a)
        _SEQUENCE[key] = {
            s: sequences.fit_sequences(rows.where((F.col("stage") == s) & (F.col("partition") == "train")))
            for s in MODEL_STAGES}
    return _SEQUENCE[key]


_SEQUENCE: dict = {}


@query("sequence_scores")
def _(a: Artefacts):
    out = None
    for s, model in sequence_models(a).items():
        part = model.predict(sequence_rows(a).where(F.col("stage") == s)).select(
            "stage", "session_id", "partition", F.col("label").cast("int").alias("y"), F.round("p", 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def sequence_attribution(a: Artefacts, per_row: bool):
    def build():
        out = None
        for s, model in sequence_models(a).items():
            rows = sequence_rows(a).where((F.col("stage") == s) & (F.col("partition") == "val"))
            part = sequences.permutation_attribution(
                rows, model.predict, per_row=per_row)
            out = part if out is None else out.unionByName(part)
        return out

    return a.table(f"sequence_attribution_{per_row}", build)


@query("permutation_attribution")
def _(a: Artefacts):
    return rounded(sequence_attribution(a, False))


def rule_sequence(a: Artefacts):
    """Sequence-side importances by rule, so that the agreement tables have comparison SQL."""
    names = F.array(*[F.lit(c) for c in sequences.SEQUENCE_FEATURES])
    rows = attributions(a).where(F.col("feature") == "price_mean").groupBy("stage", "seed").agg(
        F.avg(F.abs("shap")).alias("m")).where(F.col("seed") == 42)
    return rows.select("stage", "m", F.posexplode(names).alias("j", "feature")).select(
        "stage", "feature", (F.col("m") * ((F.col("j") * 3 + 1) % 7 + 1)).alias("mean_abs"))


_CONCEPT_ROWS = ", ".join(f"('{c}', '{f}')" for c, fs in sequences.CONCEPTS.items() for f in fs)
cte("s_concepts", f"SELECT * FROM (VALUES {_CONCEPT_ROWS}) AS t(concept, feature)")
cte("s_rule", f"""
    SELECT stage, feature AS concept, m * (((list_position({list(sequences.SEQUENCE_FEATURES)!r}, feature) - 1) * 3 + 1) % 7 + 1) AS sequence
    FROM (SELECT stage, mean_abs_shap AS m FROM a_imp WHERE seed = 42 AND feature = 'price_mean'),
      (SELECT unnest({list(sequences.SEQUENCE_FEATURES)!r}) AS feature)""")
cte("s_aligned", """
    SELECT stage, concept, sequence, sum(mean_abs_shap) AS tabular FROM s_rule
    JOIN s_concepts c USING (concept) JOIN (SELECT * FROM a_imp WHERE seed = 42) i USING (stage, feature) GROUP BY 1, 2, 3""")


@query("align_concepts", f"SELECT stage, concept, {r('sequence', 'tabular', digits=5)} FROM s_aligned")
def _(a: Artefacts):
    return rounded(sequences.align_concepts(rule_sequence(a), at.global_importance(first_seed(a))), 5)


@query("cross_paradigm", f"""
    SELECT stage, count(*) AS n_concepts, {rnd('corr(s, t)')} AS spearman, corr(s, t) > 0.6 AS passes, 0.6e0 AS threshold
    FROM (SELECT stage, rank() OVER (PARTITION BY stage ORDER BY sequence) AS s, rank() OVER (PARTITION BY stage ORDER BY tabular) AS t
      FROM s_aligned) GROUP BY 1""")
def _(a: Artefacts):
    aligned = sequences.align_concepts(rule_sequence(a), at.global_importance(first_seed(a)))
    return rounded(sequences.cross_paradigm(aligned))


cte("s_values", """
    SELECT stage, seed, session_id, concept, sum(shap) AS tabular FROM a_attr JOIN s_concepts USING (feature) GROUP BY 1, 2, 3, 4""")


@query("concept_values", f"SELECT stage, session_id, concept, {rnd('tabular', 5)} AS tabular FROM s_values WHERE seed = 42")
def _(a: Artefacts):
    return rounded(sequences.concept_values(first_seed(a)), 5)


# the other side of the agreement: one member feature's attribution, by rule
_ONE_OF = {"event_type_view": "purchase_intent_score", "log_gap_s": "click_velocity", "log_price": "price_max",
           "is_new_product": "product_revisit_rate", "is_new_category": "category_entropy"}
cte("s_other", "SELECT stage, seed, session_id, concept, shap AS sequence FROM a_attr JOIN (VALUES "
    + ", ".join(f"('{c}', '{f}')" for c, f in _ONE_OF.items()) + ") AS t(concept, feature) USING (feature)")
cte("s_both", """
    SELECT stage, seed, concept, tabular, sequence,
      rank() OVER (PARTITION BY stage, seed, concept ORDER BY round(tabular, 9))
        + (count(*) OVER (PARTITION BY stage, seed, concept, round(tabular, 9)) - 1) / 2 AS t,
      rank() OVER (PARTITION BY stage, seed, concept ORDER BY round(sequence, 9))
        + (count(*) OVER (PARTITION BY stage, seed, concept, round(sequence, 9)) - 1) / 2 AS s
    FROM s_values JOIN s_other USING (stage, seed, session_id, concept)""")
cte("s_agree", """
    SELECT stage, seed, concept, corr(t, s) AS spearman, corr(round(tabular, 9), round(sequence, 9)) AS pearson, count(*) AS n_sessions
    FROM s_both GROUP BY 1, 2, 3
    HAVING count(*) >= 30 AND stddev_pop(round(tabular, 9)) >= 1e-12 AND stddev_pop(round(sequence, 9)) >= 1e-12""")


def agreement(a: Artefacts, by=("stage",), seeds=(42,)):
    table = attributions(a).where(F.col("seed").isin(*seeds))
    other = F.create_map(*[F.lit(x) for c, f in _ONE_OF.items() for x in (f, c)])
    right = table.withColumn("concept", other[F.col("feature")]).where(F.col("concept").isNotNull()).select(
        *by, "session_id", "concept", F.round("shap", 9).alias("sequence"))
    left = sequences.concept_values(table, by).withColumn("tabular", F.round("tabular", 9))
    return sequences.per_instance_agreement(left, right, by)


@query("per_instance_agreement", f"SELECT stage, concept, {r('spearman', 'pearson', digits=5)}, n_sessions FROM s_agree WHERE seed = 42")
def _(a: Artefacts):
    return rounded(agreement(a), 5)


_MEMBERS = " ".join(f"WHEN '{c}' THEN '{', '.join(fs)}'" for c, fs in sequences.CONCEPTS.items())


@query("per_instance_table", f"""
    SELECT stage, concept, {r('spearman', 'pearson', digits=5)}, n_sessions, CASE concept {_MEMBERS} END AS tree_features,
      spearman > 0.6 AS passes FROM s_agree WHERE seed = 42""")
def _(a: Artefacts):
    return rounded(sequences.per_instance_table(agreement(a)), 5)


@query("agreement_over_seeds", f"""
    SELECT stage, concept, {rnd('avg(spearman)', 5)} AS rho_mean, {rnd('stddev_samp(spearman)', 5)} AS rho_std,
      {rnd('min(spearman)', 5)} AS rho_min, {rnd('max(spearman)', 5)} AS rho_max,
      {rnd('avg(CAST(spearman < 0 AS INT))', 5)} AS share_negative, count(*) AS n_seeds, min(n_sessions) AS n_sessions,
      avg(CAST(spearman < 0 AS INT)) IN (0, 1) AS sign_consistent FROM s_agree GROUP BY 1, 2""")
def _(a: Artefacts):
    return rounded(sequences.agreement_over_seeds(agreement(a, ("stage", "seed"), SEEDS)), 5)

