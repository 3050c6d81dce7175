"""Padded event sequences, a second model family on them, and agreement between both."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import correlation, micros
from ..functions.ranks import ROWS_PER_CHUNK, hash_rank, mid_ranks
from ..session import materialise
from ..sources.schema import EventColumns
from .attribution import _midranks

MAX_LEN = 32
MIN_SHARED = 30
# Order of the per-event features.
SEQUENCE_FEATURES = (
    "event_type_view", "event_type_cart", "event_type_remove_from_cart", "log_gap_s", "log_price",
    "is_new_product", "is_new_category",
)
# Tabular features that carry the same information as a sequence feature.
CONCEPTS = {
    "event_type_view": ("n_views",),
    "log_gap_s": ("inter_event_mean_s", "last_gap_s", "prefix_duration_s"),
    "log_price": ("price_mean", "price_max"),
    "is_new_product": ("n_unique_products", "product_revisit_rate"),
    "is_new_category": ("n_unique_categories", "category_revisit_rate"),
}


def build_sequences(
    prefix: DataFrame, *, keys: Sequence[str] = ("session_id",), max_len: int = MAX_LEN,
    cols: EventColumns = EventColumns(),
) -> DataFrame:
    """Per prefix: ``x`` (max_len rows of 7 features, padded on the right) and ``mask``.

    Longer prefixes keep their last events; only those are ever collected.
    """
    keys = list(keys)
    run = Window.partitionBy(*keys).orderBy("event_idx")
    kind = F.col(cols.kind)
    first = lambda c: (F.row_number().over(
        Window.partitionBy(*keys, c).orderBy("event_idx")) == 1).cast("float")
    gap = F.floor((micros(cols.time) - F.lag(micros(cols.time)).over(run)) / 1_000_000)
    price = F.col(cols.price) if cols.price in prefix.columns else F.lit(0.0)
    clip = lambda c: F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))
    values = [
        *[(kind == t).cast("float") for t in ("view", "cart", "remove_from_cart")],
        clip(F.coalesce(gap, F.lit(0))).cast("float"),
        F.when(price.isNotNull(), clip(price)).cast("float"),
        first(cols.product),
        first(cols.category) if cols.category in prefix.columns else F.lit(0.0).cast("float"),
    ]
    tail = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("event_idx")))
    rows = prefix.withColumns({f"_v{i}": v for i, v in enumerate(values)}).withColumn("_tail", tail).where(
        F.col("_tail") <= max_len)
    row = F.array(*[F.col(f"_v{i}") for i in range(len(values))])
    grouped = rows.groupBy(*keys).agg(
        F.first("label").alias("label"),
        F.array_sort(F.collect_list(F.struct("event_idx", row.alias("v")))).alias("_e"))  # at most max_len
    blank = F.array_repeat(F.array(*[F.lit(0.0).cast("float")] * len(values)), F.lit(max_len) - F.size("_e"))
    return grouped.select(
        *keys, "label", F.concat(F.transform("_e", lambda e: e["v"]), blank).alias("x"),
        F.concat(F.array_repeat(F.lit(True), F.size("_e")),
                 F.array_repeat(F.lit(False), F.lit(max_len) - F.size("_e"))).alias("mask"),
        F.size("_e").alias("n_steps"))


class SequenceModel:
    """A perceptron on the flattened, standardised sequence."""

    def __init__(self, scaler, network):
        self._scaler, self._network = scaler, network

    def predict(self, df: DataFrame) -> DataFrame:
        flat = df.withColumn("_f", array_to_vector(F.transform(F.flatten("x"), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))))
        scored = self._network.transform(self._scaler.transform(flat))
        return scored.withColumn("p", vector_to_array("probability")[1]).drop(
            "_f", "features", "probability", "rawPrediction", "prediction")


def fit_sequences(train: DataFrame, *, hidden: int = 8, seed: int = 42, max_iter: int = 40) -> SequenceModel:
    flat = train.select(F.col("label").cast("int").alias("y"), array_to_vector(
        F.transform(F.flatten("x"), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))).alias("_f"))
    width = len(SEQUENCE_FEATURES) * train.select(F.size("x")).first()[0]
    scaler = StandardScaler(inputCol="_f", outputCol="features", withMean=True).fit(flat)
    network = MultilayerPerceptronClassifier(
        layers=[width, hidden, 2], labelCol="y", featuresCol="features", seed=seed, maxIter=max_iter)
    return SequenceModel(scaler, network.fit(scaler.transform(flat)))


def permutation_attribution(
    rows: DataFrame, predict: Callable[[DataFrame], DataFrame], *, by: Sequence[str] = ("stage",),
    key: str = "session_id", n_repeats: int = 10, seed: int = 42, per_row: bool = False,
) -> DataFrame:
    """Change of the score when one feature's series comes from another session.

    For each feature and repeat, the r-th session of one hash order takes the
    series of the r-th session of another; all time steps move together. ``key``
    is unique within ``by``. Who lends to whom is settled on keys alone and only
    the lent series travels; joins go by sorting, since the estimated size of
    exploded rows says nothing about their memory.
    """
    by = list(by)
    base = predict(rows.select(*by, key, "x")).withColumnRenamed("p", "_p")
    n = len(SEQUENCE_FEATURES)
    trials = F.explode(F.sequence(F.lit(0), F.lit(n * n_repeats - 1))).alias("trial")
    tagged = rows.select(*by, key, trials).withColumn("_key", F.concat_ws("|", F.col(key).cast("string"), F.col("trial").cast("string")))
    groups = [*by, "trial"]
    to = hash_rank(tagged, "_key", f"{seed}|to", groups, "_rank").drop("_key")
    given = hash_rank(tagged.select(*groups, "_key", F.col(key).alias("_giver")), "_key", f"{seed}|from", groups, "_rank").drop("_key")
    j = F.pmod(F.col("trial"), F.lit(n))
    pairs = to.join(given.hint("merge"), [*groups, "_rank"]).drop("_rank")
    givers = rows.select(*by, F.col(key).alias("_giver"), F.col("x").alias("_other"))
    lent = pairs.join(givers.hint("merge"), [*by, "_giver"]).select(
        *by, key, "trial", F.transform("_other", lambda v: F.get(v, j)).alias("_series"))
    mixed = F.zip_with("x", "_series", lambda own, other: F.transform(
        own, lambda v, i: F.when(i == j, other).otherwise(v)))
    moved = lent.join(base.hint("merge"), [*by, key]).withColumn("x", mixed).drop("_series")
    names = F.array(*[F.lit(f) for f in SEQUENCE_FEATURES])
    change = predict(moved).withColumns({"feature": names[j], "_d": F.col("_p") - F.col("p")})
    keys = [*by, "feature", key] if per_row else [*by, "feature"]
    return change.groupBy(*keys).agg(F.avg(F.abs("_d")).alias("mean_abs"), F.avg("_d").alias("mean_signed"))


def _concept_rows(spark) -> DataFrame:
    rows = [(c, f) for c, fs in CONCEPTS.items() for f in fs]
    return F.broadcast(spark.createDataFrame(rows, "concept string, feature string"))  # fixed list


def align_concepts(sequence: DataFrame, importance: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Sequence importance next to the summed importance of its tabular counterparts."""
    by = list(by)
    tabular = importance.join(_concept_rows(importance.sparkSession), "feature").groupBy(*by, "concept").agg(
        F.sum("mean_abs_shap").alias("tabular"))
    return sequence.select(*by, F.col("feature").alias("concept"), F.col("mean_abs").alias("sequence")).join(
        tabular, [*by, "concept"])


def cross_paradigm(aligned: DataFrame, by: Sequence[str] = ("stage",), *, threshold: float = 0.6) -> DataFrame:
    """Spearman over concepts, from three concepts on (a handful of rows per stage)."""
    by = list(by)
    ranked = _midranks(aligned, "sequence", by).withColumnRenamed("_rank", "_s")
    ranked = _midranks(ranked, "tabular", by).withColumnRenamed("_rank", "_t")
    rho = F.coalesce(correlation("_s", "_t"), F.lit(0.0))
    n = F.count(F.lit(1))
    return ranked.groupBy(*by).agg(n.alias("n_concepts"), F.when(n >= 3, rho).alias("spearman")).withColumns(
        {"passes": F.col("spearman") > threshold, "threshold": F.lit(threshold)})


def concept_values(attribution: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Attribution summed over the tabular features of each concept, per row."""
    return attribution.join(_concept_rows(attribution.sparkSession), "feature").groupBy(
        *by, "session_id", "concept").agg(F.sum("shap").alias("tabular"))


def per_instance_agreement(
    tabular: DataFrame, sequence: DataFrame, by: Sequence[str] = ("stage",), *, min_shared: int = MIN_SHARED,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Per concept, correlation of both families' attributions over shared sessions.

    ``tabular``: (by, session_id, concept, tabular); ``sequence``: the same with
    ``sequence``. Joined on the session, never by position. Constant sides and
    fewer than ``min_shared`` sessions give no row.
    """
    by = list(by)
    keys = [*by, "concept"]
    both = materialise(tabular.join(sequence, [*keys, "session_id"]), "both_families")
    ranked = mid_ranks(both, {"tabular": "_t", "sequence": "_s"}, keys, rows_per_chunk=rows_per_chunk)
    table = ranked.groupBy(*keys).agg(
        correlation("_t", "_s").alias("spearman"), correlation("tabular", "sequence").alias("pearson"),
        F.count(F.lit(1)).alias("n_sessions"),
        ((F.stddev_pop("tabular") >= 1e-12) & (F.stddev_pop("sequence") >= 1e-12)).alias("_vary"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return table.where(F.col("_vary") & (F.col("n_sessions") >= min_shared)).select(
        *keys, zero("spearman"), zero("pearson"), "n_sessions")


def per_instance_table(agreement: DataFrame, *, threshold: float = 0.6) -> DataFrame:
    members = F.create_map(*[F.lit(x) for c, fs in CONCEPTS.items() for x in (c, ", ".join(fs))])
    return agreement.withColumns({
        "tree_features": members[F.col("concept")], "passes": F.col("spearman") > threshold}).orderBy(
        "stage", F.desc("spearman"), "concept")


def agreement_over_seeds(agreement: DataFrame) -> DataFrame:
    """Mean and spread over seeds, and whether every seed agrees on the sign."""
    negative = F.avg((F.col("spearman") < 0).cast("int"))
    return agreement.groupBy("stage", "concept").agg(
        F.avg("spearman").alias("rho_mean"), F.stddev_samp("spearman").alias("rho_std"),
        F.min("spearman").alias("rho_min"), F.max("spearman").alias("rho_max"),
        negative.alias("share_negative"), F.count(F.lit(1)).alias("n_seeds"),
        F.min("n_sessions").alias("n_sessions")).withColumn(
        "sign_consistent", (F.col("share_negative") == 0) | (F.col("share_negative") == 1))
