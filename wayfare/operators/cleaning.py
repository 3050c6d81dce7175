"""Cleaning of the raw event log and the static session table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import bool_from_text, parse_event_time
from ..session import materialise
from ..sources.schema import (
    CRITICAL_COLUMNS,
    EVENT_TYPES,
    STATIC_CATEGORICAL,
    STATIC_NUMERIC,
    STATIC_TARGET,
    validate_columns,
)

DEDUP_KEYS = ("user_id", "event_time", "event_type", "product_id")


def is_valid_event() -> Column:
    """Critical fields present and a known event type."""
    present = F.lit(True)
    for c in CRITICAL_COLUMNS:
        present = present & F.col(c).isNotNull()
    return present & F.col("event_type").isin(*EVENT_TYPES)


def dedup_events(events: DataFrame, keys=DEDUP_KEYS, order: str = "seq") -> DataFrame:
    """One row per key, the earliest in source order; null keys are equal.

    Only keys and source order are aggregated, and copies combine before that
    shuffle, so a group of copies of any size costs one row per input task. Keys
    that do occur twice are written as a table; Spark broadcasts it when it is
    small, which in a log it nearly always is, and the full rows are then
    filtered where they are, without a shuffle.
    """
    keys = list(keys)
    copies = materialise(
        events.groupBy(*keys).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first"),
        "copies")
    later = F.col(order) != F.col("_first")
    for k in keys:
        later = later & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return events.join(copies, later, "left_anti")


def clean_events(events: DataFrame) -> DataFrame:
    """Parse times, drop malformed rows, drop exact copies."""
    validate_columns(events.columns)
    return dedup_events(parse_event_time(events).where(is_valid_event()))


def flow_table(raw: DataFrame, stats: DataFrame, caps: tuple[int, int], *, gap_minutes: int,
               min_events: int, percentile: float) -> DataFrame:
    """How many events and sessions each cleaning step keeps.

    ``stats`` has one row per derived session (``n_events``, ``duration_s``) and
    ``caps`` holds the two limits. All counts come from one aggregate over the raw log and
    one over the session table, and stay exact when tasks are retried.
    """
    valid = parse_event_time(raw).agg(
        F.count(F.lit(1)).alias("e1"), F.count_if(is_valid_event()).alias("e2")
    )
    # an event without a user gets no session, so its session key joins nothing
    kept = (
        F.col("session_id").isNotNull() & (F.col("n_events") >= min_events)
        & (F.col("n_events") <= caps[0]) & (F.col("duration_s") <= caps[1])
    )
    sessions = stats.agg(
        F.sum("n_events").cast("bigint").alias("e3"),
        F.count(F.lit(1)).alias("s4"),
        F.coalesce(F.sum(F.when(kept, F.col("n_events"))), F.lit(0)).cast("bigint").alias("e5"),
        F.count_if(kept).alias("s5"),
    )
    none = F.lit(None).cast("bigint")
    text = F.lit
    steps = [
        (1, "read", text("all rows of the log"), "e1", none),
        (2, "valid", text("required columns filled, type among the known ones"), "e2", none),
        (3, "distinct", text("first of the rows that agree in user, time, type and product"), "e3", none),
        (4, "in sessions", text(f"a new session after {gap_minutes} idle minutes"), "e3", F.col("s4")),
        (5, "in kept sessions",
         text(f"at least {min_events} events; at most {caps[0]} events and {caps[1]} seconds, "
              f"the {percentile:g} quantiles"), "e5", F.col("s5")),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("step"), rule.alias("rule"),
                 F.col(n).alias("n_events"), s.alias("n_sessions"))
        for i, name, rule, n, s in steps
    ])
    order = Window.orderBy("position")  # five rows
    return (
        valid.crossJoin(F.broadcast(sessions))
        .select(F.explode(rows).alias("r")).select("r.*")
        .select(
            "position", "step", "rule", "n_events", "n_sessions",
            F.coalesce(F.lag("n_events").over(order) - F.col("n_events"), F.lit(0))
            .alias("events_removed"),
            (F.lag("n_sessions").over(order) - F.col("n_sessions")).alias("sessions_removed"),
        )
    )


def prepare_static(table: DataFrame) -> DataFrame:
    """Typed static features with a 0/1 label; any key columns are kept in front."""
    known = {*STATIC_NUMERIC, *STATIC_CATEGORICAL, STATIC_TARGET}
    return table.select(
        *[c for c in table.columns if c not in known],
        *[F.col(c).cast("double").alias(c) for c in STATIC_NUMERIC],
        *[F.col(c) for c in STATIC_CATEGORICAL if c != "Weekend"],
        bool_from_text(F.col("Weekend")).alias("Weekend"),
        bool_from_text(F.col(STATIC_TARGET)).alias("label"),
    )


def describe_static(table: DataFrame) -> DataFrame:
    label = bool_from_text(F.col(STATIC_TARGET))
    return table.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.lit(len(STATIC_NUMERIC) + len(STATIC_CATEGORICAL)).cast("bigint").alias("n_features"),
        F.sum(label).cast("bigint").alias("n_positive"),
        F.avg(label).alias("prevalence"),
    )
