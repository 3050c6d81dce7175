"""Bootstrap intervals with exact stratum sizes, spread over tasks.

Drawing a class with replacement is a multinomial draw over its rows, and rows
with equal scores are interchangeable, so a resample is a set of counts per
distinct score combination. A multinomial draw splits exactly: first over cells
of score ranges, then inside each cell. Cell totals form a small table that
every task has, so a task that holds one score range knows how many positives
and negatives lie above it and can compute its part of each metric alone; the
parts are then summed. No task holds more than one score range, and a score
shared by very many rows is a range of its own whose draw is a cell total.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pr_gain, pr_lift
from ..functions.ranks import chunk_bounds, value_chunk
from ..session import materialise_counted
from .metrics import INTERVAL_METRICS, ranking_metrics, threshold_counts

MIN_RESAMPLES = 2000
METRICS = INTERVAL_METRICS
_BLOCK = 250
_CELL_ROWS = 50_000
_CELL_LIMIT = 200_000
#: Drawn counts a task holds at once (resamples of a block times rows of a range).
_DRAWS = 12_500_000
#: Of these, what it computes with at a time: some ten arrays of this size.
_AT_ONCE = 1_000_000


def _check(n_resamples: int) -> None:
    if n_resamples < MIN_RESAMPLES:
        raise ValueError(f"at least {MIN_RESAMPLES} resamples are required, got {n_resamples}")


def joint_counts(scores: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct (scores, label)."""
    return scores.groupBy(*groups, *columns, "y").agg(F.count(F.lit(1)).alias("n"))


def _cells(joint: DataFrame, columns: Sequence[str], groups: Sequence[str], rows: int, cell_rows: int):
    """Tag rows with a score range per column; collect the cell totals; size the blocks."""
    chunks = 1
    if rows > cell_rows:
        most = int(_CELL_LIMIT ** (1 / len(columns))) // 2  # odd and even ranges
        chunks = max(2, min(most, math.ceil(rows / cell_rows) * 2))
    tagged = joint
    for j, c in enumerate(columns):
        bounds = chunk_bounds(joint, c, chunks) if chunks > 1 else []
        tagged = tagged.withColumn(f"_c{j}", value_chunk(F.col(c), bounds) if bounds else F.lit(0))
    ranges = [f"_c{j}" for j in range(len(columns))]
    totals: dict[tuple, list] = {}
    # at most _CELL_LIMIT cells per run and class
    for row in tagged.groupBy(*groups, *ranges, "y").agg(F.sum("n").alias("n")).collect():
        run = tuple(row[g] for g in groups)
        totals.setdefault(run, []).append((tuple(row[c] for c in ranges), int(row["y"]), int(row["n"])))
    block = max(1, min(_BLOCK, _DRAWS * chunks // max(rows, 1)))
    return tagged, {run: sorted(v) for run, v in totals.items()}, block


def _rng(seed: int, run: tuple, *parts) -> np.random.Generator:
    text = "|".join(map(str, (*run, *parts)))
    return np.random.default_rng([seed, zlib.crc32(text.encode())])


def _slices(size: int, width: int) -> list[slice]:
    """``size`` resamples of ``width`` counts each, cut so that a part holds ``_AT_ONCE`` counts."""
    step = max(1, _AT_ONCE // max(width, 1))
    return [slice(i, min(i + step, size)) for i in range(0, size, step)]


def _cell_draws(cells: list, run: tuple, block: int, size: int, seed: int) -> dict:
    """Per class: how many of its draws fall in each cell, for each resample of a block."""
    out = {}
    for y in (0, 1):
        own = [(c, n) for c, label, n in cells if label == y]
        weights = np.array([n for _, n in own], float)
        if len(own):
            n, rng = int(weights.sum()), _rng(seed, run, "cells", block, y)
            drawn = np.empty((size, len(own)), np.int32 if n < 1 << 31 else np.int64)
            for part in _slices(size, len(own)):  # one stream, so the cut does not change what is drawn
                drawn[part] = rng.multinomial(n, weights / weights.sum(), part.stop - part.start)
            out[y] = ({c: i for i, (c, _) in enumerate(own)}, drawn)
        else:
            out[y] = ({}, np.zeros((size, 0), int))
    return out


def _by_range(known: dict, drawn: np.ndarray, axis: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """Places of the ranges of one column that hold cells; the draws in each, and in all ranges above each."""
    place = np.array([c[axis] for c in known], int)
    order = np.argsort(place, kind="stable")
    ranges, starts = np.unique(place[order], return_index=True)
    sums = np.zeros((len(drawn), len(ranges)), np.int64)
    for part in _slices(*drawn.shape) if len(starts) else ():
        sums[part] = np.add.reduceat(drawn[part][:, order], starts, axis=1, dtype=np.int64)
    upper = np.cumsum(sums[:, ::-1], axis=1)[:, ::-1] - sums
    return {int(c): i for i, c in enumerate(ranges)}, sums, upper


def _row_draws(pdf: pd.DataFrame, names, ranges, draws: dict, run, block, size, seed):
    """Draws per row of whole cells, the same in every task that holds the cell, some resamples at a time."""
    pdf = pdf.reset_index(drop=True)
    cells = []
    for (*cell, y), part in pdf.groupby([*ranges, "y"], sort=False):
        cell = tuple(int(c) for c in cell)
        part = part.sort_values(list(names), kind="mergesort")
        known, drawn = draws[int(y)]
        weights = part["n"].to_numpy(float)
        rng = _rng(seed, run, "rows", block, cell, int(y))
        cells.append((part.index.to_numpy(), drawn[:, known[cell]].astype(np.int64), weights / weights.sum(), rng))
    for some in _slices(size, len(pdf)):
        result = np.zeros((some.stop - some.start, len(pdf)), int)
        for at, total, share, rng in cells:
            result[:, at] = rng.multinomial(total[some], share)
        yield some, result


def resampled_metrics(
    scores: DataFrame, columns: Sequence[str], groups: Sequence[str] = (), *,
    n_resamples: int = MIN_RESAMPLES, seed: int = 42, cell_rows: int = _CELL_ROWS,
) -> DataFrame:
    """PR-AUC, ROC-AUC and Brier score of every score column on every shared resample.

    One row per (run, resample ``r``, column ``axis``). Columns of one resample
    are measured on the same drawn rows, which is what pairs them.
    """
    columns, groups = list(columns), list(groups)
    joint, rows = materialise_counted(joint_counts(scores, columns, groups), "joint")
    tagged, totals, per_block = _cells(joint, columns, groups, rows, cell_rows)
    ranges = [f"_c{j}" for j in range(len(columns))]
    blocks = math.ceil(n_resamples / per_block)

    parts = []
    for j, c in enumerate(columns):
        mine = tagged.withColumn("axis", F.lit(j)).withColumn("chunk", F.col(f"_c{j}"))
        many = mine.where(F.col("chunk") % 2 == 0)
        # a range of one score needs its value only: the cell totals say the rest
        one = mine.where(F.col("chunk") % 2 == 1).groupBy(*groups, "axis", "chunk").agg(
            F.first(c).alias(c))
        one = one.select(*groups, *[F.col(c) if k == c else F.lit(0.0).alias(k) for k in columns],
                         F.lit(1).alias("y"), F.lit(1).cast("bigint").alias("n"),
                         *[F.lit(0).alias(k) for k in ranges], "axis", "chunk")
        parts.append(many.unionByName(one))
    work = parts[0]
    for p in parts[1:]:
        work = work.unionByName(p)
    work = work.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Groups of one run and block follow each other in a task, so that its cells are drawn and summed once.
    keys = [*groups, "block", "axis", "chunk"]
    width, kept = len(groups), {}

    def cells_of(run: tuple, block: int, size: int) -> dict:
        if kept.get("key") != (run, block):
            kept.clear()
            kept["key"], kept["draws"] = (run, block), _cell_draws(totals[run], run, block, size, seed)
        return kept["draws"]

    def measure(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        run, block, axis, chunk = tuple(key[:width]), int(key[width]), int(key[width + 1]), int(key[width + 2])
        size = min(per_block, n_resamples - block * per_block)
        draws = cells_of(run, block, size)
        above, n_class, here = {}, {}, {}
        for y, (known, drawn) in draws.items():
            if (y, axis) not in kept:
                kept[y, axis] = _by_range(known, drawn, axis)
            ranges_held, sums, upper = kept[y, axis]
            n_class[y] = int(drawn[0].sum()) if drawn.size else 0
            at = ranges_held.get(chunk)
            if at is None:  # this class has no row in the range
                over = [i for c, i in ranges_held.items() if c > chunk]
                above[y] = sums[:, over].sum(axis=1)
                here[y] = np.zeros(size, int)
            else:
                above[y], here[y] = upper[:, at], sums[:, at]
        found = {k: np.zeros(size) for k in ("ap", "above", "sq")}

        def add(some: slice, values: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
            tp = above[1][some, None] + np.cumsum(pos, axis=1)
            fp = above[0][some, None] + np.cumsum(neg, axis=1)
            called = np.maximum(tp + fp, 1)
            found["ap"][some] = (pos * (tp / called)).sum(axis=1)
            found["above"][some] = (neg * (tp - pos + pos / 2)).sum(axis=1)
            found["sq"][some] = (pos * (1 - values) ** 2 + neg * values**2).sum(axis=1)

        if chunk % 2:
            add(slice(0, size), np.array([pdf[columns[axis]].iloc[0]]), here[1][:, None], here[0][:, None])
        else:
            values, level = np.unique(-pdf[columns[axis]].to_numpy(float), return_inverse=True)
            y = pdf["y"].to_numpy()
            order = np.argsort(level, kind="stable")
            starts = np.searchsorted(level[order], np.arange(len(values)))
            for some, drawn in _row_draws(pdf, columns, ranges, draws, run, block, size, seed):
                pos, neg = (np.add.reduceat(np.where(y == k, drawn, 0)[:, order], starts, axis=1) for k in (1, 0))
                add(some, -values, pos, neg)
        return pd.DataFrame({
            **{g: [v] * size for g, v in zip(groups, run)},
            "axis": axis, "r": block * per_block + np.arange(size),
            "n_pos": n_class[1], "n_neg": n_class[0], **found,
        })

    kinds = dict(joint.dtypes)
    schema = ", ".join(
        [f"`{g}` {kinds[g]}" for g in groups]
        + ["axis int", "r bigint", "n_pos bigint", "n_neg bigint", "ap double", "above double", "sq double"])
    measured = work.groupBy(*keys).applyInPandas(measure, schema)
    p, q = F.col("n_pos"), F.col("n_neg")
    prevalence = p / (p + q)
    names = F.array(*[F.lit(c) for c in columns])
    summed = measured.groupBy(*groups, "axis", "r", "n_pos", "n_neg").agg(
        *[F.sum(c).alias(c) for c in ("ap", "above", "sq")])
    ap = F.try_divide("ap", p)
    return summed.select(
        *groups, names[F.col("axis")].alias("axis"), "r", ap.alias("pr_auc"),
        pr_gain(ap, prevalence).alias("pr_gain"), pr_lift(ap, prevalence).alias("pr_lift"),
        F.try_divide("above", p * q).alias("roc_auc"), F.try_divide("sq", p + q).alias("brier"),
        prevalence.alias("prevalence"))


def intervals(draws: DataFrame, metrics: Sequence[str], keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval and valid draws per metric, long form."""
    long = draws.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("m")).select(*keys, "m.*")
    ends = F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))  # one value per resample
    return long.groupBy(*keys, "metric").agg(
        F.avg("v").alias("mean"), ends.alias("_e"), F.count("v").alias("n_valid")).select(
        *keys, "metric", "mean", F.col("_e")[0].alias("ci_low"), F.col("_e")[1].alias("ci_high"), "n_valid")


def _points(scores: DataFrame, columns, groups) -> DataFrame:
    """Observed metrics per column, long form."""
    long = scores.select(*groups, "y", F.explode(F.array(*[
        F.struct(F.lit(c).alias("axis"), F.col(c).alias("score")) for c in columns])).alias("s")).select(
        *groups, "y", "s.*")
    by = [*groups, "axis"]
    found = ranking_metrics(threshold_counts(long, by), by)
    return found.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in METRICS])).alias("m")).select(*by, "m.*")


def bootstrap_multi(
    scores: DataFrame, metrics: Sequence[str] = METRICS, groups: Sequence[str] = (), *,
    n_resamples: int = MIN_RESAMPLES, alpha: float = 0.05, seed: int = 42,
) -> DataFrame:
    """Percentile intervals of several metrics on shared draws, per run."""
    _check(n_resamples)
    if not metrics:
        raise ValueError("no metrics given")
    groups = list(groups)
    draws = resampled_metrics(scores, ["score"], groups, n_resamples=n_resamples, seed=seed)
    points = _points(scores, ["score"], groups).drop("axis")
    return points.join(intervals(draws, metrics, groups, alpha), [*groups, "metric"]).select(
        *groups, "metric", "point", "ci_low", "ci_high",
        F.lit(n_resamples).alias("n_resamples"), "n_valid")


def bootstrap_ci(scores: DataFrame, metric: str, groups: Sequence[str] = (), **options) -> DataFrame:
    """Percentile interval of one metric."""
    return bootstrap_multi(scores, [metric], groups, **options)


def paired_bootstrap(
    scores: DataFrame, a: str, b: str, metric: str = "pr_auc", groups: Sequence[str] = (), *,
    n_resamples: int = MIN_RESAMPLES, alpha: float = 0.05, seed: int = 42,
) -> DataFrame:
    """Interval of metric(a) - metric(b) on the same draws; ``scores`` has both columns."""
    _check(n_resamples)
    groups = list(groups)

    def differ(table, value, keys):
        side = lambda c: F.max(F.when(F.col("axis") == c, F.col(value)))
        return table.groupBy(*keys).agg((side(a) - side(b)).alias("diff"))

    draws = differ(resampled_metrics(scores, [a, b], groups, n_resamples=n_resamples, seed=seed),
                   metric, [*groups, "r"])
    found = intervals(draws, ["diff"], groups, alpha).drop("metric", "mean")
    point = differ(_points(scores, [a, b], groups).where(F.col("metric") == metric), "point", groups)
    point = point.withColumnRenamed("diff", "point")
    joined = point.join(found, groups) if groups else point.crossJoin(F.broadcast(found))
    return joined.withColumn("n_resamples", F.lit(n_resamples))


def stratified_resample(
    scores: DataFrame, groups: Sequence[str] = (), *, resample: int = 0, seed: int = 42,
    cell_rows: int = _CELL_ROWS,
) -> DataFrame:
    """The counts of one resample: how often each (score, label) is drawn."""
    groups = list(groups)
    joint, rows = materialise_counted(joint_counts(scores, ["score"], groups), "joint")
    tagged, totals, per_block = _cells(joint, ["score"], groups, rows, cell_rows)
    width, block, at = len(groups), resample // per_block, resample % per_block

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        run = tuple(key[:width])
        draws = _cell_draws(totals[run], run, block, per_block, seed)
        pdf = pdf.reset_index(drop=True)
        parts = _row_draws(pdf, ["score"], ["_c0"], draws, run, block, per_block, seed)
        pdf["drawn"] = next(drawn[at - some.start] for some, drawn in parts if at < some.stop)
        return pdf[[*groups, "score", "y", "n", "drawn"]]

    kinds = dict(joint.dtypes)
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups]
                       + ["score double", f"y {kinds['y']}", "n bigint", "drawn bigint"])
    return tagged.groupBy(*groups, "_c0").applyInPandas(draw, schema)


def cohort_bootstrap(
    scores: DataFrame, stages: Sequence[str] = ("S1", "S2", "S3"), *,
    n_resamples: int = MIN_RESAMPLES, alpha: float = 0.05, seed: int = 42,
) -> DataFrame:
    """Levels per stage and differences between stages on one shared set of sessions.

    ``scores`` has ``stage``, ``session_id``, ``y``, ``score`` and ``seed``.
    Stages are aligned by session, never by position; a session missing at a
    stage, or with different labels, is an error.
    """
    wide = scores.groupBy("session_id").pivot("stage", list(stages)).agg(F.round(F.avg("score"), 12))
    labels = scores.groupBy("session_id").agg(
        F.min("y").alias("y"), F.max("y").alias("_y"), F.countDistinct("stage").alias("_k"))
    wide, _ = materialise_counted(wide.join(labels, "session_id"), "cohort")
    broken = wide.where((F.col("y") != F.col("_y")) | (F.col("_k") != len(stages))).first()
    if broken is not None:
        raise ValueError(f"session {broken['session_id']} is not shared by all stages with one label")
    draws = resampled_metrics(wide, list(stages), n_resamples=n_resamples, seed=seed)
    at = lambda s, m: F.max(F.when(F.col("axis") == s, F.col(m)))
    pairs = [(a, b) for i, a in enumerate(stages) for b in stages[i + 1:]]
    columns = {}
    for name, m in (("lift", "pr_lift"), ("roc_auc", "roc_auc")):
        columns |= {f"{name}.{s}": at(s, m) for s in stages}
        columns |= {f"{name}.{b}-{a}": at(b, m) - at(a, m) for a, b in pairs}
    per_draw = draws.groupBy("r").agg(*[c.alias(n.replace(".", "|")) for n, c in columns.items()])
    found = intervals(per_draw, [n.replace(".", "|") for n in columns], [], alpha)
    metric, target = (F.split("metric", r"\|")[i] for i in (0, 1))
    null = F.when(target.contains("-"), 0.0).when(metric == "lift", 1.0).otherwise(0.5)
    return found.select(
        metric.alias("metric"), target.alias("target"),
        F.when(target.contains("-"), "difference").otherwise("level").alias("kind"),
        F.round("mean", 4).alias("mean"), F.round("ci_low", 4).alias("lo"), F.round("ci_high", 4).alias("hi"),
        ((F.col("ci_low") > null) | (F.col("ci_high") < null)).alias("excludes_null"),
        F.lit(n_resamples).alias("n_resamples"))
