"""Tail probabilities for small result tables.

Spark has no error function. These run on one row per comparison, never on
event or score rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value of ``z``."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def chi2_one_p(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)))


@F.pandas_udf(DoubleType())
def sign_p(hits: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact binomial p-value at one half."""
    def one(k, m):
        low = min(k, m - k)
        return min(1.0, 2.0 * sum(math.comb(m, i) for i in range(low + 1)) / 2.0**m)

    return pd.Series([one(int(k), int(m)) for k, m in zip(hits, n)], dtype=float)


def signed_rank(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Wilcoxon signed-rank statistic and two-sided p-value of paired values.

    Exact without zero differences and up to 50 pairs (a statistic off the
    integers, from ties, is rounded to the conservative side); otherwise zeros
    are dropped and the normal approximation with tie correction is used.
    """
    d = np.asarray(a, float) - np.asarray(b, float)
    exact = len(d) <= 50 and not np.any(d == 0)
    d = d[d != 0]
    n = len(d)
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    plus = float(ranks[d > 0].sum())
    statistic = min(plus, n * (n + 1) / 2 - plus)
    if exact:
        ways = np.ones(1)
        for i in range(1, n + 1):
            longer = np.zeros(len(ways) + i)
            longer[: len(ways)] += ways
            longer[i:] += ways
            ways = longer
        share = ways / ways.sum()
        low = share[: math.ceil(plus) + 1].sum()
        high = share[math.floor(plus):].sum()
        return statistic, float(min(1.0, 2 * min(low, high)))
    mean = n * (n + 1) / 4
    _, ties = np.unique(ranks, return_counts=True)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * float((ties**3 - ties).sum())) / 24)
    return statistic, math.erfc(abs((statistic - mean) / spread) / math.sqrt(2))
