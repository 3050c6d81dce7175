"""Imports every query module, which fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sessions import sessionize
from ..operators.stages import stage_cutpoints, stage_prevalence
from ..session import configure
from ..sources.provided import provided_events
from . import (  # noqa: F401
    attribution_queries,
    comparison_queries,
    journey_queries,
    metric_queries,
    model_queries,
    split_queries,
)
from .artefacts import RULES
from .registry import ORACLES as _SQL
from .registry import QUERIES
from .sql_text import statement

__all__ = ["ORACLES", "QUERIES", "flagship"]

ORACLES = {name: statement(sql) for name, sql in _SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    events = provided_events(configure(spark), folder)
    return stage_prevalence(stage_cutpoints(sessionize(events, RULES)))
