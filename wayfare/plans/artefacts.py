"""Tables that several queries share, written once per session and input folder.

They play the part of the files that pass between the steps of a batch
pipeline: the queries downstream read Parquet instead of recomputing the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import FEATURE_SETS, stage_features
from ..operators.metrics import classification_report, select_threshold, threshold_counts
from ..operators.sessions import (
    SessionRules,
    assigned_table,
    filter_sessions,
    session_stats,
)
from ..operators.splits import grouped_split, session_table
from ..operators.stages import stage_cutpoints
from ..session import configure, materialise
from ..sources.provided import provided_events, provided_static

# The provided log is sparse: a day-long gap gives sessions of useful length.
RULES = SessionRules(gap_minutes=1440)
SEEDS = (42, 43, 44, 45, 46)
RUN = ["stage", "model", "feature_set", "seed"]

_TABLES: dict[tuple[str, str, str], DataFrame] = {}


class Artefacts:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder.rstrip("/")

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _TABLES:
            _TABLES[key] = materialise(build(), name)
        return _TABLES[key]

    # inputs -------------------------------------------------------------
    @property
    def events(self) -> DataFrame:
        return provided_events(self.spark, self.folder)

    @property
    def static(self) -> DataFrame:
        return self.table("static", lambda: provided_static(self.spark, self.folder))

    # journey ------------------------------------------------------------
    @property
    def assigned(self) -> DataFrame:
        return self.table("assigned", lambda: assigned_table(self.events, RULES))

    @property
    def stats(self) -> DataFrame:
        return self.table("stats", lambda: session_stats(self.assigned))

    @property
    def sessions(self) -> DataFrame:
        return self.table("sessions", lambda: filter_sessions(self.assigned, RULES, stats=self.stats))

    @property
    def cutpoints(self) -> DataFrame:
        return self.table("cutpoints", lambda: stage_cutpoints(self.sessions))

    @property
    def features(self) -> DataFrame:
        return self.table("features", lambda: stage_features(self.sessions))

    @property
    def session_table(self) -> DataFrame:
        return self.table("session_table", lambda: session_table(self.sessions, self.cutpoints))

    @property
    def visitors(self) -> DataFrame:
        """Session table under a visitor key of five-day blocks, so that users end."""
        block = F.floor((F.dayofmonth("session_start") - 1) / 5).cast("string")
        return self.session_table.withColumn(
            "user_id", F.concat(F.col("user_id").cast("string"), F.lit("_"), block))

    @property
    def split(self) -> DataFrame:
        return self.table("split", lambda: grouped_split(self.session_table).select(
            "session_id", "user_id", "partition", "label"))

    # scores -------------------------------------------------------------
    @property
    def scores(self) -> DataFrame:
        """Rule-based scores of every run: a fixed formula of the features, with ties."""
        return self.table("scores", self._rule_scores)

    def _rule_scores(self) -> DataFrame:
        runs = F.explode(F.array(*[
            F.struct(F.lit(name).alias("feature_set"), F.lit(i).alias("i"), F.lit(s).alias("seed"))
            for i, name in enumerate(FEATURE_SETS) for s in SEEDS
        ])).alias("r")
        i, k = F.col("r.i"), F.col("r.seed") - 42
        z = (
            (0.1 + 0.01 * k) * F.col("n_events") - (0.01 + 0.002 * i) * F.col("price_mean")
            + 0.05 * i * F.col("category_entropy") - 0.001 * i * F.col("hour_of_day")
        )
        return (
            self.features.join(self.split.select("session_id", "partition"), "session_id")
            .select("*", runs)
            .select(
                "stage", F.lit("rule").alias("model"), "r.feature_set", "r.seed", "partition",
                "session_id", F.col("label").cast("int").alias("y"),
                F.round(1 / (1 + F.exp(-z)), 3).alias("score"),
            )
        )

    @property
    def test_scores(self) -> DataFrame:
        return self.scores.where(F.col("partition") == "test").drop("partition")

    @property
    def counts(self) -> DataFrame:
        """Threshold counts of all runs on the test partition."""
        return self.table("counts", lambda: threshold_counts(self.test_scores, RUN))

    @property
    def thresholds(self) -> DataFrame:
        """F1 threshold of each run, chosen on the validation partition."""
        return self.table("thresholds", lambda: select_threshold(
            threshold_counts(self.scores.where(F.col("partition") == "val"), RUN), RUN
        ).select(*RUN, "threshold"))

    @property
    def results(self) -> DataFrame:
        """One row per run with all metrics."""
        return self.table("results", lambda: classification_report(self.counts, self.thresholds, RUN))
