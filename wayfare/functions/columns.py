"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def parse_event_time(df: DataFrame, column: str = "event_time") -> DataFrame:
    """Parse ``2019-10-01 00:00:00 UTC`` text; null when malformed, no-op on times."""
    if dict(df.dtypes)[column].startswith("timestamp"):
        return df
    text = F.regexp_replace(F.col(column), r"\s*UTC$", "")
    return df.withColumn(column, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def bool_from_text(column: Column) -> Column:
    """``TRUE``/``FALSE`` text or booleans to 0/1."""
    return F.when(F.upper(column.cast("string")) == "TRUE", 1).otherwise(0).cast("tinyint")


def first_index_where(condition: Column, index: str = "event_idx") -> Column:
    """Aggregate: the smallest index at which ``condition`` holds, else null."""
    return F.min(F.when(condition, F.col(index)))


def clip_before_purchase(cut: Column, last: Column) -> Column:
    """Null a cut that falls at or after the purchase."""
    return F.when(cut <= last, cut)


def micros(column) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def adjust_prior(p: Column, source: Column, target: Column) -> Column:
    """Rescale a probability from one class prior to another through its odds."""
    def inside(c):
        return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), c))

    p, source, target = inside(p), inside(source), inside(target)
    pos = p * (target / source)
    neg = (1 - p) * ((1 - target) / (1 - source))
    return pos / (pos + neg)


def pr_gain(ap: Column, prevalence: Column) -> Column:
    return F.when(
        (prevalence > 0) & (prevalence < 1), (ap - prevalence) / (1 - prevalence)
    ).otherwise(0.0)


def pr_lift(ap: Column, prevalence: Column) -> Column:
    return F.when(prevalence > 0, ap / prevalence).otherwise(0.0)


def ratio(top: Column, bottom: Column, default: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(default)


def half_even(x: Column) -> Column:
    """Counts are rounded half to even, as Python's ``round`` does."""
    return F.bround(x, 0).cast("bigint")


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation, null when a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
