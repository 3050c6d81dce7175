"""Checks of attributions: faithfulness, replacement curves, stability, consistency.

Explained rows are arrays (``x``, ``phi``) in model space; background rows are
numbered in hash order, and a draw picks one by number. ``predict`` adds a column ``p`` to rows with an array
``x``. Random choices are hashes of the row key and the draw number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import correlation
from ..functions.ranks import hash_rank
from ..session import materialise
from .attribution import Explanation, _midranks, model_rows

FAITHFUL = 0.5
AGREEING = 0.6

Predict = Callable[[DataFrame], DataFrame]


def linear_predictor(weights: Sequence[float], bias: float = 0.0) -> Predict:
    """Logistic score of a weighted sum."""
    w = F.array(*[F.lit(float(v)) for v in weights])

    def predict(df: DataFrame) -> DataFrame:
        z = F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(float(bias)), lambda acc, v: acc + v)
        return df.withColumn("p", 1 / (1 + F.exp(-z)))

    return predict


def _bits(*parts) -> Column:
    """A uniform integer below 2 ** 32 from the text of its parts."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def numbered_background(background: DataFrame, key: str = "session_id") -> DataFrame:
    """Background rows as (no, b), numbered from 0 in hash order of the key, slot by slot."""
    return hash_rank(background, key, "bg").select((F.col("rank") - 1).alias("no"), F.col("x").alias("b"))


def _with_background(rows: DataFrame, background: DataFrame, pick: Column) -> DataFrame:
    size = background.agg(F.count(F.lit(1)).alias("_size"))
    return rows.crossJoin(F.broadcast(size)).withColumn("no", F.pmod(pick, F.col("_size"))).join(
        background, "no").drop("no", "_size")


def _hash_order(key: Column, *parts) -> Column:
    """Feature positions 0..n-1 in hash order."""
    n = F.size("x")
    tagged = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.md5(F.concat_ws("|", key.cast("string"), *[
            p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts], i.cast("string"))).alias("h"),
        i.alias("i")))
    return F.transform(F.array_sort(tagged), lambda e: e["i"])


def _replaced(source: Column, other: Column, positions: Column) -> Column:
    return F.transform(source, lambda v, i: F.when(F.array_contains(positions, i), F.get(other, i)).otherwise(v))


def faithfulness(
    rows: DataFrame, background: DataFrame, predict: Predict, *, by: Sequence[str] = ("stage",),
    key: str = "session_id", subset_size: int | None = None, n_subsets: int = 50, seed: int = 42,
) -> DataFrame:
    """Correlation of summed attribution with the drop in prediction, over random subsets.

    Averaged over rows; rows whose sums or drops do not vary are left out.
    """
    by = list(by)
    size = F.lit(subset_size) if subset_size else F.greatest(F.lit(1), F.floor(F.size("x") / 4).cast("int"))
    base = predict(rows.select(*by, key, "x", "phi")).withColumnRenamed("p", "_p")
    draws = base.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1))))
    draws = draws.withColumn("_set", F.slice(_hash_order(F.col(key), F.col("s"), seed), 1, size))
    draws = _with_background(draws, background, _bits(F.col(key), F.col("s"), seed, "bg"))
    total = F.aggregate(F.transform("_set", lambda i: F.get("phi", i)), F.lit(0.0), lambda acc, v: acc + v)
    moved = draws.withColumn("_sum", total).withColumn("x", _replaced(F.col("x"), F.col("b"), F.col("_set")))
    scored = predict(moved).withColumn("_drop", F.col("_p") - F.col("p"))
    steady = (F.stddev_pop("_sum") >= 1e-12) & (F.stddev_pop("_drop") >= 1e-12)
    per_row = scored.groupBy(*by, key).agg(steady.alias("_ok"), correlation("_sum", "_drop").alias("r")).where("_ok")
    return per_row.groupBy(*by).agg(
        F.avg("r").alias("correlation_mean"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("correlation_std"),
        F.count(F.lit(1)).alias("n_instances")).withColumns(
        {"n_subsets": F.lit(n_subsets), "passes": F.col("correlation_mean") > FAITHFUL})


def _steps(rows: DataFrame, n_steps: int) -> DataFrame:
    step = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_steps))))
    k = lambda s: F.bround(s / n_steps * F.size("x"), 0).cast("int")
    return step.withColumns({"fraction": F.col("step") / n_steps, "k": k(F.col("step")),
                             "k_before": k(F.greatest(F.col("step") - 1, F.lit(0)))})


def replacement_curve(
    rows: DataFrame, background: DataFrame, predict: Predict, *, insert: bool, by: Sequence[str] = ("stage",),
    key: str = "session_id", n_steps: int = 10, seed: int = 42, random_draws: int = 0,
) -> DataFrame:
    """Mean prediction after replacing the first ``k`` features, per step.

    Features go in order of signed attribution, highest first; with
    ``random_draws`` they go in hash order, averaged over the draws.
    """
    by = list(by)
    if random_draws:
        rows = rows.select(*by, key, "x").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(random_draws - 1))))
        order = _hash_order(F.col(key), F.col("draw"), seed, "order")
        rows = rows.withColumn("_order", order).withColumn("phi", F.transform("x", lambda _: F.lit(0.0)))
    else:
        tagged = F.transform("phi", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
        rows = rows.select(*by, key, "x", "phi", F.lit(0).alias("draw")).withColumn(
            "_order", F.transform(F.array_sort(tagged), lambda e: e["i"]))
    rows = _with_background(rows, background, _bits(F.col(key), F.col("draw"), seed, "base"))
    moved = _steps(rows, n_steps)
    first = F.slice("_order", 1, F.col("k"))
    fresh = F.slice("_order", F.col("k_before") + 1, F.greatest(F.col("k") - F.col("k_before"), F.lit(0)))
    source, other = (F.col("b"), F.col("x")) if insert else (F.col("x"), F.col("b"))
    mean_phi = F.try_divide(
        F.aggregate(F.transform(fresh, lambda i: F.get("phi", i)), F.lit(0.0), lambda a, v: a + v), F.size(fresh))
    moved = moved.withColumn("_phi", mean_phi).withColumn("x", _replaced(source, other, first))
    return predict(moved).groupBy(*by, "step", "fraction").agg(
        F.avg("p").alias("mean_prediction"), F.coalesce(F.avg("_phi"), F.lit(0.0)).alias("step_attribution"))


def curve_summary(
    curve: DataFrame, *, insert: bool, by: Sequence[str] = ("stage",), tolerance: float = 0.02
) -> DataFrame:
    """Area under a curve and whether it moves the right way.

    Only steps that move positively attributed features are judged; the worst
    wrong step may be ``tolerance`` of the whole movement. Curves have a dozen
    points per stage.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("step")
    change = F.col("mean_prediction") - F.lag("mean_prediction").over(w)
    area = (F.col("mean_prediction") + F.lag("mean_prediction").over(w)) / 2 * (
        F.col("fraction") - F.lag("fraction").over(w))
    wrong = -F.col("_d") if insert else F.col("_d")
    table = curve.withColumns({"_d": change, "_a": area}).groupBy(*by).agg(
        F.sum("_a").alias("auc"), (F.max("mean_prediction") - F.min("mean_prediction")).alias("_move"),
        F.max(F.when((F.col("step") > 0) & (F.col("step_attribution") > 0), wrong)).alias("_worst"))
    violation = F.when(F.col("_move") > 0, F.greatest(F.lit(0.0), F.coalesce("_worst", F.lit(0.0))) / F.col("_move"))
    return table.withColumn("max_violation", F.coalesce(violation, F.lit(0.0))).select(
        *by, "auc", (F.col("max_violation") <= tolerance).alias("monotone"), "max_violation")


def deletion_curve(rows, background, predict, *, tolerance: float = 0.02, **options) -> DataFrame:
    by = options.get("by", ("stage",))
    return curve_summary(replacement_curve(rows, background, predict, insert=False, **options),
                         insert=False, by=by, tolerance=tolerance)


def insertion_curve(rows, background, predict, *, tolerance: float = 0.02, **options) -> DataFrame:
    by = options.get("by", ("stage",))
    return curve_summary(replacement_curve(rows, background, predict, insert=True, **options),
                         insert=True, by=by, tolerance=tolerance)


def random_curve(rows, background, predict, *, n_draws: int = 5, insert: bool = False, **options) -> DataFrame:
    """Area under the same curve with features in random order: the baseline."""
    by = options.get("by", ("stage",))
    curve = replacement_curve(rows, background, predict, insert=insert, random_draws=n_draws, **options)
    return curve_summary(curve, insert=insert, by=by).select(*by, "auc")


def local_lipschitz(
    rows: DataFrame, explain: Callable[[DataFrame], DataFrame], *, by: Sequence[str] = ("stage",),
    key: str = "session_id", n_perturbations: int = 5, noise_scale: float = 0.05, seed: int = 42,
) -> DataFrame:
    """Largest and mean change of attribution per unit change of input under noise.

    Noise is normal, scaled by each feature's deviation over the given rows.
    ``explain`` maps rows with ``x`` to rows with ``phi`` and keeps other columns.
    """
    by = list(by)
    cells = rows.select(*by, F.posexplode("x").alias("i", "v")).groupBy(*by, "i").agg(F.stddev_pop("v").alias("sd"))
    scales = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(  # one per feature
        "i", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd")))), lambda e: e["sd"]).alias("_sd"))
    draws = rows.select(*by, key, F.col("x").alias("_x"), F.col("phi").alias("_phi")).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(n_perturbations - 1)))).join(F.broadcast(scales), by)
    u = lambda i, tag: (_bits(F.col(key), F.col("draw"), i, seed, tag) + 0.5) / float(2**32)
    noise = F.transform("_sd", lambda sd, i: sd * noise_scale * F.sqrt(-2 * F.ln(u(i, "a"))) * F.cos(
        F.lit(6.283185307179586) * u(i, "b")))
    moved = draws.withColumn("_noise", noise).withColumn("x", F.zip_with("_x", "_noise", lambda a, b: a + b))
    keep = moved.select(*by, key, "draw", "x", "_phi", "_noise")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v))
    change = norm(F.zip_with("phi", "_phi", lambda a, b: a - b))
    ratio = F.when(norm(F.col("_noise")) > 1e-12, change / norm(F.col("_noise")))
    return explain(keep).withColumn("_r", ratio).where(F.col("_r").isNotNull()).groupBy(*by).agg(
        F.max("_r").alias("max_ratio"), F.avg("_r").alias("mean_ratio"),
        F.count_distinct(key).alias("n_instances")).withColumn("noise_scale", F.lit(noise_scale))


def stage_quality(
    explanations: Iterable[Explanation], *, n_perturbations: int = 5, noise_scale: float = 0.05, seed: int = 42,
) -> DataFrame:
    """Faithfulness, deletion and insertion curves and stability of explained stages, one row per stage.

    The stability arm attributes perturbed rows anew with the model's own
    attributions (``max_lipschitz``, ``mean_lipschitz``), trees included.
    """
    out = None
    for e in explanations:
        rows = e.arrays.withColumn("stage", F.lit(e.stage))
        back = materialise(numbered_background(model_rows(e.fitted, e.background)), "back")
        predict = lambda df, e=e: e.fitted.score_matrix(df, "x", "p")
        part = faithfulness(rows, back, predict)
        for name, curve in (("deletion", deletion_curve), ("insertion", insertion_curve)):
            found = curve(rows, back, predict).select(
                "stage", F.col("auc").alias(f"{name}_auc"), F.col("monotone").alias(f"{name}_monotone"))
            part = part.join(found, "stage")
        moved = local_lipschitz(rows, e.attribute, n_perturbations=n_perturbations, noise_scale=noise_scale, seed=seed)
        part = part.join(moved.select(
            "stage", F.col("max_ratio").alias("max_lipschitz"), F.col("mean_ratio").alias("mean_lipschitz"),
            F.col("n_instances").alias("n_perturbed")), "stage")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("quality of attributions needs at least one explained stage")
    return out


def rank_consistency(
    importance: DataFrame, *, by: Sequence[str] = ("stage",), run: str = "seed", item: str = "group",
    value: str = "mean_abs_shap", threshold: float = AGREEING,
) -> DataFrame:
    """Spearman agreement of importance orderings between every pair of runs.

    Runs and items are short lists (seeds and feature groups).
    """
    by = list(by)
    ranked = _midranks(importance.select(*by, run, item, value), value, [*by, run])
    a, b = ranked.alias("a"), ranked.alias("b")
    on = (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col(f"a.{run}") < F.col(f"b.{run}"))
    for k in by:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, on).groupBy(
        *[F.col(f"a.{k}") for k in by], F.col(f"a.{run}").alias("_a"), F.col(f"b.{run}").alias("_b")).agg(
        F.coalesce(correlation("a._rank", "b._rank"), F.lit(0.0)).alias("rho"))
    return pairs.groupBy(*by).agg(
        F.avg("rho").alias("mean_spearman"), F.min("rho").alias("min_spearman"),
        F.count(F.lit(1)).alias("n_pairs")).withColumns(
        {"threshold": F.lit(threshold), "passes": F.col("mean_spearman") > threshold})
