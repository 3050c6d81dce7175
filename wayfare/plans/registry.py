"""Registry of named queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artefacts import Artefacts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Means of whole microseconds often end exactly half way; both engines round up.
NUDGE = 1e-9


def query(name: str, sql: str | None = None):
    """Register ``fn(artefacts)`` under ``name``, with comparison SQL where it exists."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Artefacts(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and clear negative zero, so that two engines agree on the text."""
    return df.select(*[
        (F.round(F.col(f"`{n}`") + NUDGE, digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
        for n, t in df.dtypes
    ])


def rnd(sql: str, digits: int = 6) -> str:
    """SQL twin of one column of :func:`rounded`."""
    return f"round({sql} + {NUDGE}, {digits}) + 0.0e0"


def r(*names: str, digits: int = 6) -> str:
    """SQL list of rounded columns."""
    return ", ".join(f'round("{n}" + {NUDGE}, {digits}) + 0.0e0 AS "{n}"' for n in names)


def ntz(df: DataFrame) -> DataFrame:
    """Times without a zone, as the provided tables hold them."""
    return df.select(*[
        F.col(n).cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(n) for n, t in df.dtypes
    ])
