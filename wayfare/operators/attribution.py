"""Feature attribution and the tables built on it.

Attributions are long: ``stage``, ``seed``, ``session_id``, ``feature``,
``value``, ``shap``. All validation rows are explained against all train rows
unless the caller gives a size: what the background contributes is one mean per
feature, or one count per leaf and pattern of its box.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import correlation
from ..functions.ranks import ROWS_PER_CHUNK, hash_cut, keyed_hash, mid_ranks
from ..session import materialise, new_path
from .features import FEATURES, feature_names
from .many_fits import fit_many, with_places
from .models import FittedModel, beside, fit_model
from .preprocess import preprocess
from .stages import MODEL_STAGES

CORRELATED = 0.95


def hash_sample(rows: DataFrame, limit: int | None, seed: int | str, key: str = "session_id") -> DataFrame:
    """At most ``limit`` rows, the first in seeded hash order; all rows without a limit."""
    if limit is None:
        return rows
    cut = hash_cut(rows.select(key), key, seed, lambda n: F.least(n, F.lit(int(limit))))
    return rows.crossJoin(F.broadcast(cut)).where(keyed_hash(key, seed) <= F.col("cut")).drop("cut")  # one row


# values --------------------------------------------------------------------------
def linear_attribution(explain: DataFrame, background: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Exact Shapley values of a linear score: weight times distance from the background mean.

    ``explain`` keeps its key columns; every feature becomes a row with ``value``
    and ``shap``.
    """
    features = list(weights)
    means = background.agg(*[F.avg(c).alias(f"_m_{c}") for c in features])
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 (F.lit(float(w)) * (F.col(c) - F.col(f"_m_{c}"))).alias("shap"))
        for c, w in weights.items()
    ])
    keys = [c for c in explain.columns if c not in features]
    return explain.crossJoin(F.broadcast(means)).select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def tree_leaves(model, session: SparkSession | None = None) -> list[tuple[float, dict[int, tuple[float, float]]]]:
    """Leaves of a fitted tree ensemble as (value, box per feature) on the raw score.

    The nodes come from the saved model, a Parquet table. A boosted leaf counts
    its margin (twice the summed prediction is the log-odds); a forest leaf
    counts the positive share over the number of trees. A model has at most
    trees times 2 ** depth leaves.
    """
    session = session or SparkSession.getActiveSession()
    path = new_path(session, "model")
    model.save(path)
    nodes = session.read.parquet(f"{path}/data")
    boosted = hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")
    rows = nodes.select("treeID", "nodeData.*").collect() if "treeID" in nodes.columns else nodes.collect()
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"] if "treeID" in r.asDict() else 0, {})[r["id"]] = r
    tree_weights = list(model.treeWeights)
    leaves = []
    for t, table in sorted(trees.items()):
        scale = 2.0 * tree_weights[t] if boosted else 1.0 / len(trees)
        stack = [(0, {})]
        while stack:
            node, box = stack.pop()
            r = table[node]
            if r["leftChild"] < 0:
                if boosted:
                    value = r["prediction"]
                else:
                    stats = np.asarray(r["impurityStats"], float)
                    value = stats[1] / stats.sum()
                leaves.append((scale * value, box))
                continue
            f, cut = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
            low, high = box.get(f, (-np.inf, np.inf))
            stack.append((r["leftChild"], {**box, f: (low, min(high, cut))}))
            stack.append((r["rightChild"], {**box, f: (max(low, cut), high)}))
    return leaves


#: Per leaf the patterns seen, a bit per condition of its box, and how many rows show each.
Patterns = list[tuple[np.ndarray, np.ndarray]]


def _codes(columns: np.ndarray, box: dict[int, tuple[float, float]]) -> np.ndarray:
    """Which conditions of a box each row meets, as bits; ``columns`` holds a row per feature."""
    out = np.zeros(columns.shape[1], np.int64)
    for k, (f, (low, high)) in enumerate(box.items()):
        out |= ((columns[f] > low) & (columns[f] <= high)).astype(np.int64) << k
    return out


def box_patterns(background: np.ndarray, leaves) -> Patterns:
    """Per leaf, how many background rows meet which conditions of its box."""
    columns = np.ascontiguousarray(background.T)
    return [np.unique(_codes(columns, box), return_counts=True) for _, box in leaves]


def background_patterns(background: DataFrame, leaves) -> Patterns:
    """As :func:`box_patterns`, over a table of rows ``x``: one sum per leaf and pattern.

    A leaf of depth ``d`` has at most ``2 ** d`` patterns, so the model bounds the result.
    """
    def count(batches):
        for pdf in batches:
            if len(pdf):
                found = box_patterns(np.vstack(pdf["x"].to_numpy()), leaves)
                yield pd.DataFrame({"leaf": np.repeat(np.arange(len(found), dtype=np.int32), [len(p) for p, _ in found]),
                                    "pattern": np.concatenate([p for p, _ in found]),
                                    "n": np.concatenate([n for _, n in found])})

    table = background.select("x").mapInPandas(count, "leaf int, pattern long, n long")
    met = table.groupBy("leaf", "pattern").agg(F.sum("n").alias("n")).orderBy("leaf", "pattern").toArrow()
    leaf, pattern, n = (met[c].to_numpy() for c in ("leaf", "pattern", "n"))
    ends = np.searchsorted(leaf, np.arange(len(leaves) + 1))
    return [(pattern[i:j], n[i:j]) for i, j in zip(ends, ends[1:])]


#: Pairs of a row's and a background pattern that are held at a time.
_PAIRS = 1 << 18


def _earned(seen: np.ndarray, patterns: np.ndarray, counts: np.ndarray, depth: int, value: float) -> np.ndarray:
    """What each condition's feature earns of a leaf, for rows of the patterns ``seen``."""
    bits = np.arange(depth)
    q, p = (((c[:, None] >> bits) & 1).astype(float) for c in (seen, patterns))
    share = value * counts / counts.sum()
    out = np.zeros(q.shape)
    step = max(1, _PAIRS // max(1, len(p)))
    for i in range(0, len(q), step):
        met, not_met = q[i:i + step], 1 - q[i:i + step]
        weight = (not_met @ (1 - p).T == 0) * share
        u, v = (met @ (1 - p).T).astype(int), (not_met @ p.T).astype(int)
        gain = _SHARE[np.maximum(u - 1, 0), v] * (u > 0) * weight
        loss = _SHARE[u, np.maximum(v - 1, 0)] * (v > 0) * weight
        out[i:i + step] = met * (gain @ (1 - p)) - not_met * (loss @ p)
    return out


def leaf_shapley(x: np.ndarray, background: np.ndarray | Patterns, leaves) -> np.ndarray:
    """Interventional Shapley values of a sum of boxes, averaged over the background.

    ``background`` holds rows, or their counts by :func:`background_patterns`.
    A leaf is reached by a mix of a row and a background row when every feature
    of its box is taken from a side that lies in it. With ``u`` features only
    the row satisfies and ``v`` only the background row does, each of the ``u``
    earns (u-1)! v! / (u+v)! of the leaf, each of the ``v`` loses u! (v-1)! / (u+v)!.
    Rows that meet the same conditions earn the same, so this is worked out once per pattern.
    """
    columns = np.ascontiguousarray(x.T)
    out = np.zeros(columns.shape)
    known = box_patterns(background, leaves) if isinstance(background, np.ndarray) else background
    for (value, box), (patterns, counts) in zip(leaves, known):
        if not box or not len(patterns):
            continue
        seen, at = np.unique(_codes(columns, box), return_inverse=True)
        earned = _earned(seen, patterns, counts, len(box), value)
        for k, f in enumerate(box):
            out[f] += earned[at, k]
    return np.ascontiguousarray(out.T)


_SIZE = 32
_SHARE = np.array([[factorial(a) * factorial(b) / factorial(a + b + 1) for b in range(_SIZE)] for a in range(_SIZE)])


def tree_attributor(model, background: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Shapley values of a tree ensemble, as a function that adds ``phi`` to rows with a model-space array ``x``.

    ``background`` holds rows ``x`` too; only its counts per leaf and pattern
    travel, as a broadcast that the model bounds (see :func:`tree_leaves`). They
    are taken once, so the function serves any number of tables; other columns stay.
    """
    session = background.sparkSession
    leaves = tree_leaves(model, session)
    known = session.sparkContext.broadcast((leaves, background_patterns(background, leaves)))

    def explain(batches):
        leaves, patterns = known.value
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["x"].to_numpy())
                yield pdf.assign(phi=list(leaf_shapley(x, patterns, leaves)))

    def attribute(rows: DataFrame) -> DataFrame:
        schema = ", ".join([f"`{k}` {kind}" for k, kind in rows.dtypes] + ["phi array<double>"])
        keys = [k for k, kind in rows.dtypes if not kind.startswith("array")]
        spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 2, *keys)
        return spread.mapInPandas(explain, schema)

    return attribute


def to_long(arrays: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    labels = F.array(*[F.lit(n) for n in names])
    cells = F.explode(F.arrays_zip(labels.alias("feature"), F.col("x").alias("value"), F.col("phi").alias("shap")))
    return arrays.select(*keys, cells.alias("c")).select(*keys, "c.feature", "c.value", "c.shap")


def attributor(
    fitted: FittedModel, background: DataFrame, *, background_size: int | None = None, seed: int = 42,
) -> Callable[[DataFrame], DataFrame]:
    """Interventional Shapley values of a fitted model, as a function that adds ``phi`` to rows with ``x``."""
    chosen = fitted.preprocessor.transform(hash_sample(background, background_size, seed)).select(
        vector_to_array("features").alias("x"))
    if fitted.kind != "logreg":
        return tree_attributor(fitted.estimator, chosen)
    w = fitted.estimator.coefficients.toArray()
    mean = chosen.agg(*[F.avg(F.col("x")[i]) for i in range(len(w))]).first()
    phi = F.zip_with(
        F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b),
        F.array(*[F.lit(float(c)) for c in w]), lambda d, c: d * c)
    return lambda rows: rows.withColumn("phi", phi)


def stage_attribution(
    fitted: FittedModel, explain: DataFrame, background: DataFrame, *, background_size: int | None = None,
    seed: int = 42, keys: Sequence[str] = ("session_id",),
) -> DataFrame:
    """Interventional Shapley values of a fitted stage model, as (keys, x, phi)."""
    attribute = attributor(fitted, background, background_size=background_size, seed=seed)
    return attribute(model_rows(fitted, explain, keys))


def model_rows(fitted: FittedModel, rows: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Feature rows as (keys, model-space array ``x``)."""
    return fitted.preprocessor.transform(rows).select(*keys, vector_to_array("features").alias("x"))


class Explanation:
    """One stage's model, background and attributions (written once); ``attribute`` explains further rows."""

    def __init__(self, stage, seed, fitted, background, arrays, attribute):
        self.stage, self.seed, self.fitted = stage, seed, fitted
        self.background, self.arrays, self.attribute = background, arrays, attribute

    @property
    def names(self) -> list[str]:
        return self.fitted.preprocessor.names

    def long(self) -> DataFrame:
        return to_long(self.arrays, self.names, ["session_id"]).select(
            F.lit(self.stage).alias("stage"), F.lit(self.seed).alias("seed"), "*")


def explain_stages(
    features: DataFrame, split: DataFrame, *, stages: Sequence[str] = MODEL_STAGES, model: str = "gbt",
    seed: int = 42, params: dict | None = None, imbalance: str = "class_weight",
    background_size: int | None = None, max_explain: int | None = None,
) -> dict[str, Explanation]:
    """Fit one model per stage on train and explain its validation rows."""
    def prepare(stage):
        rows = features.where(F.col("stage") == stage).join(
            split.select("session_id", "partition"), "session_id").withColumn("y", F.col("label").cast("int"))
        return materialise(rows, "explain_rows")

    def explain(task):
        stage, rows = task
        return explain_rows(rows, feature_names(stage), stage=stage, model=model, seed=seed, params=params,
                            imbalance=imbalance, background_size=background_size, max_explain=max_explain)

    tables = [(stage, prepare(stage)) for stage in stages]
    found = beside(features.sparkSession, explain, tables, max((t.count() for _, t in tables), default=0))
    return {stage: e for (stage, _), e in zip(tables, found) if e is not None}


def explain_rows(rows: DataFrame, columns: Sequence[str], *, stage: str, model: str = "gbt", seed: int = 42,
                 params=None, imbalance="class_weight", background_size: int | None = None,
                 max_explain: int | None = None) -> Explanation | None:
    """Fit on the train rows of one table and explain its validation rows."""
    train, val = (rows.where(F.col("partition") == p) for p in ("train", "val"))
    if train.isEmpty() or val.isEmpty():
        return None
    fitted = fit_model(train, model, columns, seed=seed, params=params, imbalance=imbalance)
    chosen = hash_sample(val, max_explain, seed)
    attribute = attributor(fitted, train, background_size=background_size, seed=seed)
    arrays = materialise(attribute(model_rows(fitted, chosen)), "attribution")
    return Explanation(stage, seed, fitted, train, arrays, attribute)


# tables ---------------------------------------------------------------------------
def _ranked(table: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Share of the total and rank; features per stage are a short list.

    Features that are equal row by row differ in the last digits of their sums, by the order of summation. Shares
    equal to ten digits are a tie, which the name decides.
    """
    total = F.sum("mean_abs_shap").over(Window.partitionBy(*by))
    share = F.when(total > 0, F.col("mean_abs_shap") / total).otherwise(F.col("mean_abs_shap"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("share", 10)), name)
    return table.withColumn("share", share).withColumn("rank", F.row_number().over(order))


def global_importance(attribution: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Mean absolute and mean signed attribution per feature, share and rank."""
    table = attribution.groupBy(*by, "feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap"), F.avg("shap").alias("mean_signed_shap"))
    return _ranked(table, by, "feature")


def _midranks(table: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Mid-ranks of short lists (features, concepts); rows of data go through ``mid_ranks``."""
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, column))
    return table.withColumn("_rank", F.rank().over(w.orderBy(column)) + (ties - 1) / 2)


def rank_correlations(attribution: DataFrame, by: Sequence[str] = ("stage",), *, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Spearman correlation of the values of every pair of features per stage.

    A session's ranks meet in one row; the products of all pairs are summed by one aggregate with partial results.
    ``attribution`` is read several times and should be a written table.
    """
    by = list(by)
    values = attribution.where(F.col("session_id").isNotNull()).select(*by, "session_id", "feature", "value")
    ranked = mid_ranks(values, {"value": "rank"}, [*by, "feature"], rows_per_chunk=rows_per_chunk)
    # one entry per feature: a fixed number per explained row
    rows = ranked.groupBy(*by, "session_id").agg(F.array_sort(F.collect_list(F.struct("feature", "rank"))).alias("c"))

    def partners(x, i):
        return F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(
            x["feature"].alias("a"), y["feature"].alias("b"), x["rank"].alias("x"), y["rank"].alias("y")))

    pairs = rows.select(*by, F.explode(F.flatten(F.transform("c", partners))).alias("p")).select(*by, "p.*")
    return pairs.where("a < b").groupBy(*by, "a", "b").agg(correlation("x", "y").alias("rho"))


def correlation_groups(attribution: DataFrame, *, threshold: float = CORRELATED) -> DataFrame:
    """(stage, feature, group): features linked by an absolute Spearman of at least ``threshold``.

    A constant feature has no correlation and stays alone. Group names are the
    sorted members joined by ``+``.
    """
    edges: dict[str, list[tuple[str, str]]] = {}
    strong = rank_correlations(attribution).where(
        F.abs("rho") >= threshold)
    for r in strong.collect():  # at most the pairs of the feature list
        edges.setdefault(r["stage"], []).append((r["a"], r["b"]))
    rows = []
    for r in attribution.select("stage", "feature").distinct().collect():
        rows.append((r["stage"], r["feature"]))
    out = []
    for stage in sorted({s for s, _ in rows}):
        label = {f: f for s, f in rows if s == stage}
        changed = True
        while changed:
            changed = False
            for a, b in edges.get(stage, []):
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    changed = True
        members: dict[str, list[str]] = {}
        for f, root in label.items():
            members.setdefault(root, []).append(f)
        out += [(stage, f, "+".join(sorted(fs))) for fs in members.values() for f in fs]
    return attribution.sparkSession.createDataFrame(sorted(out), "stage string, feature string, `group` string")


def reference_groups(groups: DataFrame) -> DataFrame:
    """(feature, group) of the earliest stage, used at every stage."""
    first = groups.agg(F.min("stage").alias("stage"))
    return groups.join(F.broadcast(first), "stage", "left_semi").select("feature", "group")


def group_members(names: DataFrame) -> DataFrame:
    """(feature, group) recovered from group names."""
    return names.select("group").distinct().select(
        F.explode(F.split("group", r"\+")).alias("feature"), "group")


def grouped_attribution(
    attribution: DataFrame, groups: DataFrame, by: Sequence[str] = ("stage",)
) -> DataFrame:
    """Attribution summed (not averaged) over the members of each group, share and rank."""
    per_feature = global_importance(attribution, by).drop("share", "rank")
    table = per_feature.join(F.broadcast(groups), "feature").groupBy(*by, "group").agg(  # one row per feature
        F.count(F.lit(1)).alias("n_members"), F.sum("mean_abs_shap").alias("mean_abs_shap"),
        F.sum("mean_signed_shap").alias("mean_signed_shap"))
    return _ranked(table, by, "group")


def attribution_migration(importance: DataFrame, stages: Sequence[str] = MODEL_STAGES) -> DataFrame:
    """How each group's share, rank and sign move over the stages.

    Every group has a row at every stage; one that does not exist there is
    marked unavailable, not zero. Changes are against the first stage, and stay
    null when the group has no value there.
    """
    present = importance.select("stage").distinct()
    grid = importance.select("group").distinct().crossJoin(F.broadcast(present))
    order = F.create_map(*[F.lit(x) for i, s in enumerate(stages) for x in (s, i)])[F.col("stage")]
    full = grid.join(importance.withColumn("available", F.lit(True)), ["group", "stage"], "left")
    w = Window.partitionBy("group").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c).over(w)
    return full.withColumn("available", F.coalesce("available", F.lit(False))).withColumns({
        "share_change": F.col("share") - first("share"),
        "rank_change": F.col("rank") - first("rank"),
        "reversed_sign": F.signum("mean_signed_shap") != F.signum(first("mean_signed_shap"))})


def migration_table(attribution: DataFrame, *, grouped: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """Migration under the reference grouping, or per feature."""
    if not grouped:
        table = global_importance(attribution).withColumnRenamed("feature", "group").withColumn(
            "n_members", F.lit(1).cast("bigint"))
        return attribution_migration(table)
    groups = reference_groups(correlation_groups(attribution)) if groups is None else groups
    return attribution_migration(grouped_attribution(attribution, groups))


def static_contrast(migration: DataFrame, stages: Sequence[str] = MODEL_STAGES) -> DataFrame:
    """Per group: the mean share a static view reports against peak, trough and range."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(stages) for x in (s, i)])[F.col("stage")]
    here = migration.where(F.col("available") & F.col("share").isNotNull()).withColumn("_o", order)
    # the first stage wins a tie
    peak = F.max(F.struct("share", (-F.col("_o")).alias("o"), "stage"))
    trough = F.min(F.struct("share", F.col("_o").alias("o"), "stage"))
    table = here.groupBy("group").agg(
        F.avg("share").alias("static_share"), F.max("share").alias("peak_share"),
        F.min("share").alias("_low"), peak.alias("_p"), trough.alias("_t"),
        F.min("_o").alias("_first"), F.max("_o").alias("_last"), F.count(F.lit(1)).alias("n_stages"))
    inner = lambda o: (o > F.col("_first")) & (o < F.col("_last"))
    return table.where(F.col("n_stages") >= 2).select(
        "group", "static_share", (F.col("peak_share") - F.col("_low")).alias("range_share"),
        F.col("_p.stage").alias("peak_stage"), "peak_share", F.col("_t.stage").alias("trough_stage"),
        (inner(-F.col("_p.o")) | inner(F.col("_t.o"))).alias("non_monotone"),
        (F.col("peak_share") - F.col("static_share")).alias("static_understates_peak_by"), "n_stages").orderBy(F.desc("range_share"), "group")


def aggregate_shares(shares: DataFrame, groups: DataFrame, *, check: bool = True) -> DataFrame:
    """Sum feature shares into groups; a feature outside them keeps its ablation group."""
    known = F.create_map(*[F.lit(x) for f in FEATURES for x in (f.name, f.group)])
    mapped = shares.join(F.broadcast(groups), "feature", "left")  # one row per feature
    if check and mapped.where(F.col("group").isNotNull()).isEmpty():
        raise ValueError("no feature maps to the grouping; the contrast would be meaningless")
    target = F.coalesce("group", known[F.col("feature")], "feature")
    return mapped.groupBy(target.alias("group")).agg(F.sum("share").alias("share"))


def contrast_table(importance: DataFrame, whole: DataFrame, stages: Sequence[str] = MODEL_STAGES) -> DataFrame:
    """Shares per stage next to the whole-session share of the same group."""
    wide = importance.groupBy("group").pivot("stage", list(stages)).agg(F.first("share"))
    peak = F.greatest(*[F.col(s) for s in stages])
    at = F.lit(None).cast("string")
    for s in reversed(stages):
        at = F.when(F.col(s) == peak, F.lit(s)).otherwise(at)
    return (
        wide.join(whole.withColumnRenamed("share", "whole_session_share"), "group", "left")
        .where(peak.isNotNull())
        .withColumn("whole_session_share", F.coalesce("whole_session_share", F.lit(0.0)))
        .select("group", *[F.col(s).alias(f"share_{s}") for s in stages], peak.alias("stage_peak"),
                at.alias("stage_peak_at"), "whole_session_share",
                (peak - F.col("whole_session_share")).alias("flattening"))
        .orderBy(F.desc("flattening"), "group")
    )


def null_shares(attribution: DataFrame, groups: DataFrame) -> DataFrame:
    """Grouped shares of every permutation round."""
    return grouped_attribution(attribution, groups, ("round", "stage")).select("round", "stage", "group", "share")


def null_table(observed: DataFrame, nulls: DataFrame) -> DataFrame:
    """Observed share against its permutation null, p with the add-one correction.

    A group missing from a round counts as share 0 there.
    """
    rounds = nulls.select("round").distinct()
    if rounds.isEmpty():
        raise ValueError("no null rounds; the comparison has no reference")
    grid = observed.select("stage", "group", F.col("share").alias("observed")).crossJoin(F.broadcast(rounds))
    filled = grid.join(nulls, ["round", "stage", "group"], "left").withColumn(
        "share", F.coalesce("share", F.lit(0.0)))
    return filled.groupBy("stage", "group", "observed").agg(
        F.round(F.avg("share"), 4).alias("null_mean"), F.round(F.stddev_samp("share"), 4).alias("null_sd"),
        F.round(F.max("share"), 4).alias("null_max"),
        F.round((F.count_if(F.col("share") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1), 4).alias("p_value"),
        F.count(F.lit(1)).alias("n_rounds")).withColumn(
        "observed_share", F.round("observed", 4)).drop("observed")


def permutation_null(
    features: DataFrame, split: DataFrame, *, n_rounds: int = 20, seed: int = 42, model: str = "gbt", **options
) -> tuple[DataFrame, DataFrame]:
    """Observed grouped shares and those of refits on shuffled labels, same grouping and budget.

    Linear models take :func:`linear_permutation_null`, which fits all stages and rounds in shared passes.
    """
    if model == "logreg" and not set(options) - {"stages"}:
        return linear_permutation_null(features, split, n_rounds=n_rounds, seed=seed, **options)
    options["model"] = model
    from .splits import permute_labels

    def long(table):
        found = explain_stages(table, split, seed=seed, **options)
        out = None
        for e in found.values():
            out = e.long() if out is None else out.unionByName(e.long())
        if out is None:
            raise ValueError("every stage lacks train or val rows; nothing to permute")
        return out

    real = long(features)
    groups = reference_groups(correlation_groups(real))
    observed = grouped_attribution(real, groups).select("stage", "group", "share")
    nulls = None
    for i in range(n_rounds):
        shuffled = long(permute_labels(features, f"{seed}|{i}"))
        part = grouped_attribution(shuffled, groups).select(F.lit(i).alias("round"), "stage", "group", "share")
        nulls = part if nulls is None else nulls.unionByName(part)
    return observed, nulls


def linear_permutation_null(
    features: DataFrame, split: DataFrame, *, n_rounds: int = 20, seed: int = 42, stages: Sequence[str] = MODEL_STAGES,
    inverse_penalty: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """The null of a linear model: every (stage, round) is one response over rows that are prepared once.

    The attribution of a linear score is weight times distance from the train mean, so a round's mean
    absolute attribution of a feature is its absolute weight times one mean over the validation rows.
    """
    spark, names, parts = features.sparkSession, {}, None
    rows = features.where(F.col("stage").isin(list(stages))).join(
        split.select("session_id", "partition"), "session_id").withColumn("y", F.col("label").cast("int"))
    rows = materialise(with_places(rows, ["stage"]), "null_rows")
    sizes = {r["stage"]: r for r in rows.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.count_if(F.col("partition") == "train").alias("train"),
        F.count_if(F.col("partition") == "val").alias("val")).collect()}  # one row per stage
    for stage in stages:
        if stage not in sizes or not sizes[stage]["train"] or not sizes[stage]["val"]:
            continue
        own = rows.where(F.col("stage") == stage)
        prepared = preprocess(own.where(F.col("partition") == "train"), feature_names(stage), scale=True)
        names[stage] = prepared.names
        part = prepared.transform(own).select(
            F.col("stage").alias("group"), "session_id", "partition", "place", vector_to_array("features").alias("x"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("every stage lacks train or val rows; nothing to permute")
    ready = materialise(parts, "null_ready")
    width = {g: len(n) for g, n in names.items()}
    fits = fit_many(ready.where("partition = 'train'"), {g: (sizes[g]["n"], sizes[g]["pos"]) for g in names}, width,
                    n_rounds=n_rounds, seed=seed, inverse_penalty=inverse_penalty)
    cells = ready.select("group", "partition", "session_id", F.posexplode("x").alias("i", "value"))
    centre = cells.where("partition = 'train'").groupBy("group", "i").agg(F.avg("value").alias("mean"))
    table = spark.createDataFrame(
        [(g, i, f, float(fits.weights[g][0, i])) for g, own in names.items() for i, f in enumerate(own)],
        "group string, i int, feature string, weight double")
    known = F.broadcast(table.join(centre, ["group", "i"]))  # one row per stage and feature
    real = materialise(cells.where("partition = 'val'").join(known, ["group", "i"]).select(
        F.col("group").alias("stage"), "session_id", "feature", "value",
        (F.col("weight") * (F.col("value") - F.col("mean"))).alias("shap")), "null_observed")
    groups = reference_groups(correlation_groups(real))
    observed = grouped_attribution(real, groups).select("stage", "group", "share")
    spread = cells.where("partition = 'val'").join(F.broadcast(centre), ["group", "i"]).groupBy("group", "i").agg(
        F.avg(F.abs(F.col("value") - F.col("mean"))).alias("spread"))
    drawn = spark.createDataFrame(
        [(r - 1, g, i, f, float(fits.weights[g][r, i])) for g, own in names.items() for r in range(1, n_rounds + 1) for i, f in enumerate(own)],
        "round int, group string, i int, feature string, weight double")  # rounds times stages times features
    drawn = drawn.join(F.broadcast(spread), ["group", "i"]).select(
        "round", F.col("group").alias("stage"), "feature", (F.abs("weight") * F.col("spread")).alias("shap"))
    return observed, null_shares(drawn, groups)



def entropy_availability(attribution: DataFrame, feature: str = "category_entropy") -> DataFrame:
    """Share of explained rows where a feature is positive, and its attribution share
    overall and among those rows."""
    defined = attribution.where(F.col("feature") == feature).select(
        "stage", "session_id", (F.col("value") > 0).alias("_defined"))
    size = F.abs("shap")
    own = F.col("feature") == feature
    table = attribution.join(defined, ["stage", "session_id"], "left").groupBy("stage").agg(
        F.coalesce(F.max(own), F.lit(False)).alias("feature_present"),
        F.count_if(own).alias("n_explained"),
        F.avg(F.when(own, (F.col("value") > 0).cast("int"))).alias("_share"),
        F.sum(F.when(own, size)).alias("_own"), F.sum(size).alias("_all"),
        F.sum(F.when(own & F.col("_defined"), size)).alias("_own_d"),
        F.sum(F.when(F.col("_defined"), size)).alias("_all_d"))
    part = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).when(F.col(b) == 0, 0.0), 4)
    return table.select(
        "stage", "feature_present", "n_explained", F.round("_share", 4).alias("share_prefixes_defined"),
        part("_own", "_all").alias("attribution_share_overall"),
        part("_own_d", "_all_d").alias("attribution_share_when_defined"))


# points behind plots -----------------------------------------------------------------
def _top(attribution: DataFrame, n: int) -> DataFrame:
    return global_importance(attribution).where(F.col("rank") <= n).select("stage", "feature", "rank")


def beeswarm_points(attribution: DataFrame, n: int = 12) -> DataFrame:
    """Attribution of the top features with the feature value scaled to its rank in 0 to 1."""
    w = Window.partitionBy("stage", "feature")
    place = F.row_number().over(w.orderBy("value", "session_id")) - 1
    top = F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    return attribution.join(F.broadcast(_top(attribution, n)), ["stage", "feature"]).withColumn(
        "value_rank", place / top).select("stage", "feature", "rank", "session_id", "shap", "value_rank")


def dependence_points(attribution: DataFrame, n: int = 3) -> DataFrame:
    """(value, attribution) pairs of each stage's strongest features."""
    return attribution.join(F.broadcast(_top(attribution, n)), ["stage", "feature"]).select(
        "stage", "feature", "rank", "session_id", "value", "shap")


def feature_peak_importance(attribution: DataFrame, n: int = 15) -> DataFrame:
    """Features with the highest importance at any stage."""
    return global_importance(attribution).groupBy("feature").agg(
        F.max("mean_abs_shap").alias("peak")).orderBy(F.desc("peak"), "feature").limit(n)
