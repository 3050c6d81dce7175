"""User-safe splits and deterministic samples.

Samples and random splits are filters on a seeded hash: ``hash_cut`` finds the
hash of the k-th key, and a row is in the sample when its own hash is not above
it. Whole users, nested sizes and independence from row order follow directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import half_even, micros
from ..functions.ranks import hash_cut, hash_rank, keyed_hash, running_totals
from ..session import materialise_counted
from ..sources.schema import STATIC_MONTHS

RATIOS = (0.70, 0.15, 0.15)
MIN_SESSIONS = 52_000
PARTITIONS = ("train", "val", "test")


class SplitError(ValueError):
    """A split would break its own rules."""


class SubsampleError(ValueError):
    """A sample would be smaller than the agreed floor."""


def _check_ratios(ratios) -> None:
    if abs(sum(ratios) - 1.0) > 1e-9 or any(r <= 0 for r in ratios):
        raise SplitError(f"ratios must be positive and sum to 1, got {ratios}")


def session_table(
    sessions: DataFrame, cutpoints: DataFrame, *, session: str = "session_id",
    time: str = "event_time", user: str = "user_id",
) -> DataFrame:
    """User, start time and label per session."""
    starts = sessions.groupBy(session).agg(
        F.min(user).alias("user_id"), F.min(time).alias("session_start"))
    return starts.join(cutpoints.select(session, "label"), session)


def _first_k(users: DataFrame, totals: DataFrame, k: int, seed: str) -> tuple | None:
    """The (value, hash) of the k-th user in order of (first_us, hash)."""
    if k <= 0:
        return None
    hit = totals.where((F.col("n_cum") - F.col("n") < k) & (F.col("n_cum") >= k)).first()
    tied = users.where(F.col("first_us") == hit["first_us"])
    rest = k - (hit["n_cum"] - hit["n"])
    cut = hash_cut(tied, "user_id", seed, lambda n: F.lit(rest)).first()["cut"]
    return hit["first_us"], cut


def temporal_split(table: DataFrame, *, ratios=RATIOS) -> DataFrame:
    """Users in order of first session, cut by ratio; users crossing their boundary go.

    ``table`` is a :func:`session_table`. Only two boundary users are looked up;
    no user is ranked one by one, and every session row is placed by comparing
    its user's first session with the two boundaries. Users first seen at the
    same instant are ordered by a hash of their id.
    """
    _check_ratios(ratios)
    seed = "first"
    users = table.groupBy("user_id").agg(
        F.min(micros("session_start")).alias("first_us"),
        F.max(micros("session_start")).alias("last_us"),
    )
    users, n_users = materialise_counted(users, "users")
    n_train, n_val = round(n_users * ratios[0]), round(n_users * ratios[1])
    totals = running_totals(users.groupBy("first_us").agg(F.count(F.lit(1)).alias("n")), "first_us", ["n"])

    def up_to(k):
        found = _first_k(users, totals, k, seed)
        if found is None:
            return F.lit(False)
        value, cut = found
        same = F.col("first_us") == F.lit(value)
        return (F.col("first_us") < F.lit(value)) | (same & (keyed_hash("user_id", seed) <= F.lit(cut)))

    placed = users.withColumn(
        "partition",
        F.when(up_to(n_train), "train").when(up_to(n_train + n_val), "val").otherwise("test"),
    )
    edges = placed.agg(
        F.min(F.when(F.col("partition") == "val", F.col("first_us"))).alias("to_val"),
        F.min(F.when(F.col("partition") == "test", F.col("first_us"))).alias("to_test"),
    ).first()
    crosses = (
        (F.col("partition") == "train") & (F.col("last_us") >= F.lit(edges["to_val"]).cast("bigint"))
    ) | ((F.col("partition") == "val") & (F.col("last_us") >= F.lit(edges["to_test"]).cast("bigint")))
    keep = placed.where(~F.coalesce(crosses, F.lit(False)))
    return table.join(keep.select("user_id", "partition"), "user_id")


def temporal_boundaries(split: DataFrame) -> DataFrame:
    """First session start of the val and test users, and of users kept in train."""
    return split.groupBy("partition").agg(
        F.min("session_start").alias("first_start"), F.max("session_start").alias("last_start"))


def grouped_split(table: DataFrame, *, ratios=RATIOS, seed: int = 42) -> DataFrame:
    """Random split by user with exact partition sizes."""
    _check_ratios(ratios)
    users = table.select("user_id").distinct()
    train, val = (F.lit(float(r)) for r in ratios[:2])
    first = hash_cut(users, "user_id", seed, lambda n: half_even(n * train), name="_train")
    second = hash_cut(
        users, "user_id", seed, lambda n: half_even(n * train) + half_even(n * val), name="_val")
    h = keyed_hash("user_id", seed)
    bounds = first.join(second, how="full")  # one row
    return (
        table.crossJoin(F.broadcast(bounds))
        .withColumn(
            "partition", F.when(h <= F.col("_train"), "train").when(h <= F.col("_val"), "val")
            .otherwise("test"))
        .drop("_train", "_val")
    )


def split_report(split: DataFrame, *, check: bool = True) -> DataFrame:
    """Sizes and prevalence per partition; an empty partition is an error."""
    part = F.col("partition")
    columns = [F.count(F.lit(1)).alias("n_sessions")]
    for p in PARTITIONS:
        columns.append(F.count_if(part == p).alias(f"n_{p}"))
    for p in PARTITIONS:
        columns.append(F.avg(F.when(part == p, F.col("label").cast("int"))).alias(f"prevalence_{p}"))
    report = split.agg(*columns)
    if check:
        row = report.first()
        empty = [p for p in PARTITIONS if row[f"n_{p}"] == 0]
        if empty:
            raise SplitError(f"the split leaves {empty} empty")
    return report


def freeze_split(split: DataFrame, path: str, *, overwrite: bool = False) -> str:
    """Write a split once; an existing one is not replaced unless asked."""
    columns = ["session_id", "user_id", "partition", "label"]
    mode = "overwrite" if overwrite else "errorifexists"
    split.select(*[c for c in columns if c in split.columns]).write.mode(mode).parquet(path)
    return path


def load_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_join(features: DataFrame, split: DataFrame) -> DataFrame:
    """Attach the partition to a feature matrix."""
    return features.join(split.select("session_id", "partition"), "session_id")


def month_boundaries(table: DataFrame, *, months=STATIC_MONTHS, ratios=RATIOS) -> DataFrame:
    """One row: the first val month and first test month closest to the ratios."""
    _check_ratios(ratios)
    # at most as many rows as there are months
    sizes = table.groupBy(_month_index(months).alias("month_idx")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("month_idx")
    shares = sizes.select(
        "month_idx",
        (F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         / F.sum("n").over(Window.partitionBy())).alias("before"),
        F.row_number().over(w).alias("i"),
    )
    a, b = shares.alias("a"), shares.alias("b")
    cost = (F.col("a.before") - ratios[0]) ** 2 + (F.col("b.before") - (ratios[0] + ratios[1])) ** 2
    return (
        a.join(b, (F.col("a.i") > 1) & (F.col("a.i") < F.col("b.i")))
        .select(F.col("a.month_idx").alias("val_from"), F.col("b.month_idx").alias("test_from"),
                cost.alias("cost"))
        .orderBy("cost", "val_from", "test_from")
        .limit(1)
    )


def _month_index(months):
    return F.create_map(*[F.lit(x) for i, m in enumerate(months) for x in (m, i)])[F.col("Month")]


def month_split(table: DataFrame, *, months=STATIC_MONTHS, ratios=RATIOS) -> DataFrame:
    """Month-ordered split of the static table; a month never straddles partitions."""
    if "Month" not in table.columns:
        raise SplitError("the static table has no Month column")
    unknown = [r[0] for r in table.where(~F.coalesce(F.col("Month").isin(*months), F.lit(False)))
               .select("Month").distinct().limit(5).collect()]
    if unknown:
        raise SplitError(f"unexpected Month values {unknown}")
    best = month_boundaries(table, months=months, ratios=ratios).first()
    if best is None:
        raise SplitError("need at least 3 distinct months to split")
    index = _month_index(months)
    return table.withColumn(
        "partition",
        F.when(index < best["val_from"], "train").when(index < best["test_from"], "val")
        .otherwise("test"),
    )


def subsample_users(
    sessions: DataFrame, n_users: int, *, seed: int = 42, min_sessions: int = MIN_SESSIONS,
    user: str = "user_id", session: str = "session_id",
) -> DataFrame:
    """All sessions of a seeded sample of users; larger samples contain smaller ones."""
    users = sessions.select(user).where(F.col(user).isNotNull()).distinct()
    size = F.lit(int(n_users))
    cut = hash_cut(users, user, seed, lambda n: F.least(n, size))
    sample = sessions.crossJoin(F.broadcast(cut)).where(  # one row
        keyed_hash(user, seed) <= F.col("cut")).drop("cut")
    if min_sessions:
        found = sample.select(session).distinct().count()
        if found < min_sessions:
            raise SubsampleError(f"{found} sessions, below the floor of {min_sessions}")
    return sample


def subsample_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Users, sessions and events before and after sampling."""
    def sizes(df, suffix):
        per_session = df.groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("n"))
        per_user = per_session.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("s"), F.sum("n").alias("n"))
        return per_user.agg(
            F.count(F.lit(1)).alias(f"n_users_{suffix}"), F.sum("s").alias(f"n_sessions_{suffix}"),
            F.sum("n").alias(f"n_events_{suffix}"))

    return sizes(before, "before").crossJoin(F.broadcast(sizes(after, "after")))  # one row each


def stratified_slice(
    rows: DataFrame, fraction: float, *, key: str = "session_id", label: str = "label",
    seed: int = 0, groups=(),
) -> DataFrame:
    """Label-stratified sample, at least one row per class, with ``in_slice`` on all rows."""
    by = [*groups, label]
    cut = hash_cut(
        rows, key, seed, lambda n: F.greatest(F.lit(1), half_even(n * F.lit(float(fraction)))), by)
    # one row per group and class
    return rows.join(cut, by, "left").withColumn(
        "in_slice", keyed_hash(key, seed) <= F.col("cut")).drop("cut")


def common_cohort(features: DataFrame, stages=("S1", "S2", "S3")) -> DataFrame:
    """Sessions present at every stage."""
    return (
        features.where(F.col("stage").isin(*stages))
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == len(stages))
        .select("session_id")
    )


def permute_labels(
    rows: DataFrame, seed: int | str, *, key: str = "session_id", label: str = "label",
    groups=("stage",),
) -> DataFrame:
    """Shuffle the label within each group: the r-th row of one hash order takes
    the label of the r-th row of another."""
    groups = list(groups)
    to = hash_rank(rows.drop(label), key, "to", groups, "_rank")
    given = hash_rank(rows.select(*groups, key, label), key, seed, groups, "_rank")
    return to.join(given.select(*groups, "_rank", label), [*groups, "_rank"]).drop("_rank")
