"""Imputation, scaling, one-hot encoding and class balance, fitted on train rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import (
    ROWS_PER_CHUNK,
    hash_rank,
    running_totals,
    value_positions,
)
from ..session import materialise, materialise_counted

MAX_LEVELS = 15
MIN_SHARE = 0.01
INFREQUENT = "infrequent"


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """One row per non-null cell: (feature, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("value").isNotNull())


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of all columns.

    A sketch first brackets each median between two values about two percent of
    the rows apart; only the values inside the brackets are then counted.
    """
    columns = list(columns)
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    ends = doubles.approxQuantile(columns, [0.49, 0.51], 0.004)
    bracket = {c: e for c, e in zip(columns, ends) if e}
    if not bracket:
        return {}
    row = doubles.agg(
        *[F.count(c).alias(f"n_{c}") for c in bracket],
        *[F.count_if(F.col(c) < lo).alias(f"b_{c}") for c, (lo, _) in bracket.items()]).first()
    inside = doubles.select(*[
        F.when((F.col(c) >= lo) & (F.col(c) <= hi), F.col(c)).alias(c) for c, (lo, hi) in bracket.items()])
    counts = _long(inside, list(bracket), "double").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    running = running_totals(counts, "value", ["n"], ["feature"])
    skipped = F.create_map(*[F.lit(x) for c in bracket for x in (c, row[f"b_{c}"])])[F.col("feature")]
    total = F.create_map(*[F.lit(x) for c in bracket for x in (c, row[f"n_{c}"])])[F.col("feature")]
    low, high = F.floor((total - 1) / 2), F.ceil((total - 1) / 2)
    first, last = skipped + F.col("n_cum") - F.col("n"), skipped + F.col("n_cum")
    pick = lambda r: F.max(F.when((r >= first) & (r < last), F.col("value")))
    found = running.groupBy("feature").agg(((pick(low) + pick(high)) / 2).alias("m"))
    return {r["feature"]: r["m"] for r in found.collect()}  # one row per column


def column_levels(
    df: DataFrame, columns: Sequence[str], *, max_levels: int = MAX_LEVELS, min_share: float = MIN_SHARE
) -> tuple[dict[str, str], dict[str, tuple[list[str], bool]]]:
    """Most frequent value per column, and its encoded levels.

    Returns ``modes`` and ``levels`` (kept levels, whether an infrequent level
    exists). Ties go to the smaller value for the mode. A level is kept with at
    least ``min_share`` of the rows, and at most ``max_levels`` outputs remain;
    of equally rare levels the smaller value is dropped first.
    """
    counts = _long(df, columns, "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    counts, _ = materialise_counted(counts, "levels")
    top = counts.groupBy("feature").agg(F.max("n").alias("top"), F.sum("n").alias("present"),
                                        F.count(F.lit(1)).alias("distinct"))
    modes = {
        r["feature"]: r["mode"]
        for r in counts.join(F.broadcast(top), "feature").where(F.col("n") == F.col("top"))
        .groupBy("feature").agg(F.min("value").alias("mode")).collect()
    }
    # missing cells take the mode before levels are counted
    rows = df.count()
    sizes = {r["feature"]: (r["present"], r["distinct"]) for r in top.collect()}
    common: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    # at most 1 / min_share levels per column have that share
    frequent = counts.where(F.col("n") >= F.lit(min_share * rows)).collect()
    for r in frequent:
        common[r["feature"]].append((r["value"], r["n"]))
    levels = {}
    for c in columns:
        present, distinct = sizes.get(c, (0, 0))
        fill = rows - present
        own = {v: n + (fill if v == modes.get(c) else 0) for v, n in common[c]}
        if c in modes and modes[c] not in own and fill >= min_share * rows:
            own[modes[c]] = fill
        rare = distinct > len(own)
        if len(own) + rare > max_levels:
            order = sorted(sorted(own), key=lambda v: own[v])
            own = {v: own[v] for v in order[len(own) - (max_levels - 1):]}
            rare = True
        levels[c] = (sorted(own), rare)
    return modes, levels


@dataclass
class Preprocessor:
    """Fitted preprocessing; ``names`` are the model-space columns in vector order."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    levels: dict[str, tuple[list[str], bool]]
    means: dict[str, float]
    scales: dict[str, float]

    @property
    def names(self) -> list[str]:
        out = list(self.numeric)
        for c in self.categorical:
            kept, rare = self.levels[c]
            out += [f"{c}={v}" for v in kept] + ([f"{c}={INFREQUENT}"] if rare else [])
        return out

    def columns(self):
        for c in self.numeric:
            filled = F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c, 0.0)))
            yield ((filled - self.means[c]) / self.scales[c]) if c in self.means else filled
        for c in self.categorical:
            kept, rare = self.levels[c]
            value = F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c)))
            for v in kept:
                yield F.coalesce(value == v, F.lit(False)).cast("double")
            if rare:
                yield (~F.coalesce(value.isin(*kept), F.lit(False))).cast("double")

    def transform(self, df: DataFrame, name: str = "features") -> DataFrame:
        """Add the feature vector; one projection, no shuffle."""
        temporary = [f"_x{i}" for i in range(len(self.names))]
        wide = df.withColumns(dict(zip(temporary, self.columns())))
        return VectorAssembler(inputCols=temporary, outputCol=name).transform(wide).drop(*temporary)


def preprocess(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), *, scale: bool = False
) -> Preprocessor:
    """Fit on train rows: median and most-frequent imputation, levels, optional scaling."""
    medians = column_medians(train, numeric) if numeric else {}
    modes, levels = column_levels(train, categorical) if categorical else ({}, {})
    means, scales = {}, {}
    if scale:
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))) for c in numeric}
        row = train.agg(*[F.avg(e).alias(f"m_{c}") for c, e in filled.items()],
                        *[F.stddev_pop(e).alias(f"s_{c}") for c, e in filled.items()]).first()
        means = {c: row[f"m_{c}"] for c in numeric}
        scales = {c: row[f"s_{c}"] or 1.0 for c in numeric}
    return Preprocessor(list(numeric), list(categorical), medians, modes, levels, means, scales)


def class_weights(rows: DataFrame, label: str = "y", groups: Sequence[str] = ()) -> DataFrame:
    """Balanced weight per class and the ratio of negatives to positives."""
    y = F.col(label).cast("int")
    sized = rows.groupBy(*groups).agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"))
    if sized.where(F.col("n_pos") == 0).first() is not None:
        raise ValueError("class weights need at least one positive row")
    n = F.col("n_pos") + F.col("n_neg")
    return sized.select(
        *groups, "n_pos", "n_neg", F.try_divide(n, 2 * F.col("n_neg")).alias("weight_neg"),
        (n / (2 * F.col("n_pos"))).alias("weight_pos"), (F.col("n_neg") / F.col("n_pos")).alias("neg_per_pos"))


def with_class_weight(rows: DataFrame, label: str = "y", name: str = "weight") -> DataFrame:
    w = class_weights(rows, label).first()
    return rows.withColumn(
        name, F.when(F.col(label) == 1, F.lit(w["weight_pos"])).otherwise(F.lit(w["weight_neg"])))


def near_rows(
    rows: DataFrame, k: int, *, key: str, features: str, seed: int, projections: int = 3, reach: int | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK, width: int = 100_000,
) -> DataFrame:
    """Add ``near``: distance ``d`` and key ``k`` of the ``k`` closest rows among neighbours along random projections.

    Each projection sorts the rows once and every row looks at the ``reach``
    rows on either side, so the cost is linear and equal rows, however many,
    form no group. The neighbours are approximate. Keys are unique. Projections start
    from the same written table, and of their neighbours only distance and key leave them.
    """
    reach = reach or 2 * k
    width = max(width, 2 * reach)
    size = F.size(features)
    table, n = materialise_counted(rows.select(key, features), "minority")
    me = F.struct(F.col(key).alias("k"), F.col(features).alias("x"))

    def gap(c):
        return F.aggregate(F.zip_with(c["x"], F.col(features), lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                           lambda acc, v: acc + v)

    found = None
    for p in range(projections):
        # a fixed direction per projection, from the hash of the position
        along = F.aggregate(
            F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(features, i) * (
                F.pmod(F.xxhash64(i, F.lit(f"{seed}|{p}")), F.lit(2001)) / 1000.0 - 1.0)),
            F.lit(0.0), lambda acc, v: acc + v)
        placed = value_positions(table.withColumn("_p", along), "_p", key, seed, n, rows_per_chunk=rows_per_chunk)
        # Blocks of neighbouring positions, each with the rows next to it on either side.
        block, at = F.floor(F.col("pos") / width), F.col("pos") % width
        placed = placed.drop("_p").withColumn("_block", F.explode(F.array_compact(F.array(
            block, F.when(at < reach, block - 1), F.when(at >= width - reach, block + 1)))))
        w = Window.partitionBy("_block").orderBy("pos")
        around = F.concat(
            F.collect_list(me).over(w.rowsBetween(-reach, -1)), F.collect_list(me).over(w.rowsBetween(1, reach)))
        closest = F.slice(F.array_sort(F.transform("_c", lambda c: F.struct(gap(c).alias("d"), c["k"].alias("k")))), 1, k)
        part = placed.withColumn("_c", around).where(F.col("_block") == block).select(key, closest.alias("near"))
        found = part if found is None else found.unionByName(part)
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))
    return table.join(found.groupBy(key).agg(F.slice(merged, 1, k).alias("near")).hint("merge"), key)


def smote_oversample(
    train: DataFrame, *, label: str = "y", key: str = "session_id", features: str = "features",
    k: int = 5, seed: int = 42,
) -> DataFrame:
    """Synthetic minority rows so that both classes have equal size.

    Returns (key, label, features as array, synthetic). Every minority row seeds
    the same number of new rows (the remainder goes in hash order); each new row
    lies between its seed and one of the seed's near minority rows.
    """
    if dict(train.dtypes)[features] == "vector":
        train = train.withColumn(features, vector_to_array(features))
    sizes = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    minority = min((0, 1), key=lambda c: sizes.get(c, 0))
    small, large = sizes.get(minority, 0), sizes.get(1 - minority, 0)
    if small <= k:
        raise ValueError(f"the minority class has {small} rows; more than k = {k} are needed")
    each, rest = divmod(large - small, small)
    rows = train.where(F.col(label) == minority)
    near = materialise(near_rows(rows, k, key=key, features=features, seed=seed), "near")
    seeds = hash_rank(near, key, seed)
    copies = F.lit(each) + (F.col("rank") <= rest).cast("int")
    draw = lambda tag: F.conv(F.substring(F.md5(F.concat_ws(
        "|", F.col(key).cast("string"), F.col("i").cast("string"), F.lit(f"{seed}{tag}"))), 1, 8), 16, 10).cast("double") / float(2**32)
    made = seeds.where(copies > 0).withColumn("i", F.explode(F.sequence(F.lit(1), copies)))
    other = F.get("near", F.floor(draw("n") * F.size("near")).cast("int"))["k"]
    made = made.select(key, features, "i", draw("u").alias("u"), other.alias("_k"))
    made = made.join(rows.select(F.col(key).alias("_k"), F.col(features).alias("_other")).hint("merge"), "_k", "left")
    point = F.zip_with(features, "_other", lambda a, b: a + (b - a) * F.col("u"))
    synthetic = made.select(
        F.concat(F.col(key).cast("string"), F.lit("#"), F.col("i").cast("string")).alias(key),
        F.lit(minority).alias(label), point.alias(features), F.lit(True).alias("synthetic"))
    return train.select(F.col(key).cast("string").alias(key), F.col(label).cast("int").alias(label), features,
                        F.lit(False).alias("synthetic")).unionByName(synthetic)
