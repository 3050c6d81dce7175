"""Many logistic responses fitted in shared passes over one table of features.

A permutation null refits a model on many shuffled labels of the same rows. Rows are neither copied nor
shuffled for that: a row knows its place in an order where the positives come first, and a round's label is
positive if a keyed bijection sends that place to one of the first ``n_pos``. So each round deals exactly as many
positives as there are, and a task computes all labels of a row by itself.

The solver's state is one weight vector per (group, response). One Newton step of all of them is one
pass: a task adds up the gradients and curvatures of its rows as matrix products, and these sums, of a size
that depends on features and responses only, are added up per (group, response) in a second stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import hash_rank

_ROUNDS_OF_MIXING = 4


def permuted_places(place: np.ndarray, n: int, key: str) -> np.ndarray:
    """A keyed bijection of ``0 .. n - 1``, for any subset of places.

    Four Feistel rounds on the next even number of bits; what falls beyond ``n`` walks on until it is inside.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh3_64_intdigest(f"{key}|{r}")) for r in range(_ROUNDS_OF_MIXING)]

    def mixed(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = mixed(place.astype(np.uint64))
    beyond = np.flatnonzero(out >= n)
    while len(beyond):
        out[beyond] = mixed(out[beyond])
        beyond = beyond[out[beyond] >= n]
    return out.astype(np.int64)


def responses(place: np.ndarray, n: int, n_pos: int, seed: int | str, n_rounds: int) -> np.ndarray:
    """The observed label and those of ``n_rounds`` permutations, a column each."""
    drawn = [place < n_pos] + [permuted_places(place, n, f"{seed}|{r}") < n_pos for r in range(n_rounds)]
    return np.column_stack(drawn).astype(float)


def with_places(rows: DataFrame, groups: Sequence[str], label: str = "y", key: str = "session_id") -> DataFrame:
    """``place``: the row's position within its group, positives first, in hash order within a label."""
    sizes = rows.groupBy(*groups).agg(F.sum(label).cast("long").alias("_pos"))
    ranked = hash_rank(rows, key, "place", [*groups, label], "_rank").join(F.broadcast(sizes), list(groups))  # one row per group
    shift = F.when(F.col(label) == 1, 0).otherwise(F.col("_pos"))
    return ranked.withColumn("place", F.col("_rank") - 1 + shift).drop("_rank", "_pos")


@dataclass
class ManyFits:
    """``weights[group]``: one row per response, the intercept last."""

    weights: dict[str, np.ndarray]
    passes: int


def _sums(rows: DataFrame, width: dict[str, int], n_responses: int, make) -> dict[tuple[str, int], np.ndarray]:
    """Per (group, response) the sum over all rows of the vectors that ``make(group, x, y)`` gives, one row a response."""
    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            group = np.array(batch.column(0).to_pylist(), object)
            for g in dict.fromkeys(group):
                at = np.flatnonzero(group == g)
                part = batch.take(pa.array(at))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width[g])
                x = np.column_stack([x, np.ones(len(at))])
                found = make(g, x, part.column(2).to_numpy(zero_copy_only=False))
                total[g] = total[g] + found if g in total else found
        for g, sums in total.items():
            yield pa.RecordBatch.from_pylist(
                [{"group": g, "response": r, "sums": sums[r].tolist()} for r in range(n_responses)], schema)

    def added(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for g, r, sums in zip(*[c.to_pylist() for c in batch.columns]):
                total[g, r] = total.get((g, r), 0.0) + np.array(sums)
        if total:
            yield pa.RecordBatch.from_pylist([{"group": g, "response": r, "sums": s.tolist()} for (g, r), s in total.items()], schema)

    schema = pa.schema([("group", pa.string()), ("response", pa.int32()), ("sums", pa.list_(pa.float64()))])
    names = "group string, response int, sums array<double>"
    met = rows.select("group", "x", "place").mapInArrow(partial, names).repartition("group", "response").mapInArrow(added, names)
    return {(r["group"], r["response"]): np.array(r["sums"]) for r in met.collect()}  # one row per group and response


def fit_many(
    rows: DataFrame, sizes: dict[str, tuple[int, int]], width: dict[str, int], *, n_rounds: int, seed: int | str,
    inverse_penalty: float = 1.0, max_passes: int = 40, tolerance: float = 1e-9,
) -> ManyFits:
    """Balanced ridge logistic fits of the observed label and ``n_rounds`` permuted ones of every group.

    ``rows``: the train rows as (group, x, place); ``sizes``: rows and positives of each group over *all* rows, which is
    what labels are dealt over; ``width``: features of each group. The loss is the mean weighted one plus half the
    squared weights over ``inverse_penalty`` times the train rows; the intercept is free. A step that does not lower a response's loss is halved.
    """
    k = n_rounds + 1
    labels = {g: (n, p) for g, (n, p) in sizes.items()}

    def drawn(g, place):
        return responses(place, *labels[g], seed, n_rounds)

    def counted(g, x, place):
        y = drawn(g, place)
        return np.column_stack([np.full(k, float(len(y))), y.sum(axis=0)])

    seen = _sums(rows, width, k, counted)
    count = {key: (v[0], v[1]) for key, v in seen.items()}
    groups = sorted({g for g, _ in count})
    weights = {g: np.zeros((k, width[g] + 1)) for g in groups}
    for (g, r), (n, p) in count.items():
        if not 0 < p < n:
            raise ValueError(f"a response of {g} has one class only among the train rows")
    best = {key: (np.inf, None, None) for key in count}
    active, passes = set(count), 0
    while active and passes < max_passes:
        passes += 1
        now = {g: weights[g].copy() for g in groups}
        scale = {g: np.array([[count[g, r][0] / (2 * (count[g, r][0] - count[g, r][1])), count[g, r][0] / (2 * count[g, r][1])] for r in range(k)])
                 for g in groups}
        live = {g: [r for r in range(k) if (g, r) in active] for g in groups}

        def stepped(g, x, place, now=now, scale=scale, live=live):
            d = x.shape[1]
            out = np.zeros((k, 1 + d + d * d))
            if not live[g]:
                return out
            y = drawn(g, place)[:, live[g]]
            margin = x @ now[g][live[g]].T
            p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            w = np.where(y == 1, scale[g][live[g], 1], scale[g][live[g], 0])
            loss = (w * (np.logaddexp(0, margin) - y * margin)).sum(axis=0)
            slope = (w * (p - y)).T @ x
            curve = w * p * (1 - p)
            for i, r in enumerate(live[g]):
                out[r, 0], out[r, 1:1 + d] = loss[i], slope[i]
                out[r, 1 + d:] = ((x * curve[:, i:i + 1]).T @ x).ravel()
            return out

        seen = _sums(rows.where(F.col("group").isin([g for g in groups if live[g]])), width, k, stepped)
        for g, r in sorted(active):
            d, n = width[g] + 1, count[g, r][0]
            w = weights[g][r]
            ridge = np.append(np.full(d - 1, 1 / (inverse_penalty * n)), 0.0)
            sums = seen[g, r] / n  # the weights of a response add up to n
            value = sums[0] + (ridge * w * w).sum() / 2
            floor, at, _ = best[g, r]
            if value > floor + 1e-13 * abs(floor):
                weights[g][r] = at + (w - at) / 2
                if np.abs(weights[g][r] - at).max() < 1e-12:
                    weights[g][r] = at
                    active.discard((g, r))
                continue
            slope = sums[1:1 + d] + ridge * w
            curve = sums[1 + d:].reshape(d, d) + np.diag(ridge)
            step = -np.linalg.lstsq(curve, slope, rcond=1e-14)[0]
            best[g, r] = (value, w.copy(), step)
            if np.abs(slope).max() < tolerance:
                active.discard((g, r))
                continue
            weights[g][r] = w + step
    return ManyFits(weights, passes)
