"""Journey stages: event order, stage cut-points, prefixes and their tables.

S1 closes at the second event with a product. S2 closes at the second browsing
signal (a repeat view or a category switch) if that comes after S1 and before
any cart. S3 closes at the first cart if that is not before S1. S4 is the first
purchase or the last event and is descriptive only. S1 to S3 must fall strictly
before the first purchase; a stage out of order is not reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clip_before_purchase, first_index_where
from ..sources.schema import EventColumns

STAGES = ("S1", "S2", "S3", "S4")
MODEL_STAGES = ("S1", "S2", "S3")
STAGE_TEXT = {
    "S1": "first catalogue contact, closed by the second product interaction",
    "S2": "browsing, closed by the second repeat view or category switch",
    "S3": "cart activity, closed by the first cart event",
    "S4": "purchase window, closed by the purchase or the end of the session",
}


class StageError(ValueError):
    """A stage is unknown or cannot have a prefix."""


def _check_model_stage(stage: str) -> None:
    if stage not in STAGES:
        raise StageError(f"unknown stage {stage!r}, expected one of {STAGES}")
    if stage not in MODEL_STAGES:
        raise StageError(f"{stage} ends at the label event; stages with prefixes: {MODEL_STAGES}")


def order_events(sessions: DataFrame, cols: EventColumns = EventColumns()) -> DataFrame:
    """0-based ``event_idx`` within the session, by time and then source order."""
    w = Window.partitionBy(cols.session).orderBy(cols.time, cols.order)
    return sessions.withColumn("event_idx", F.row_number().over(w).cast("bigint") - 1)


def repeat_view_flag(ordered: DataFrame, cols: EventColumns = EventColumns(),
                     name: str = "repeat_view") -> DataFrame:
    """A view of a product seen earlier in the session; null products count as one."""
    seen = Window.partitionBy(cols.session, cols.product).orderBy("event_idx")
    return ordered.withColumn(
        name, (F.col(cols.kind) == "view") & (F.row_number().over(seen) > 1)
    )


def category_switch_flag(ordered: DataFrame, cols: EventColumns = EventColumns(),
                         name: str = "category_switch") -> DataFrame:
    """A view whose category differs from the previous event's; both known."""
    if cols.category not in ordered.columns:
        return ordered.withColumn(name, F.lit(False))
    w = Window.partitionBy(cols.session).orderBy("event_idx")
    differs = F.coalesce(F.col(cols.category) != F.lag(cols.category).over(w), F.lit(False))
    return ordered.withColumn(name, (F.col(cols.kind) == "view") & differs)


def running_ordinals(flagged: DataFrame, cols: EventColumns = EventColumns()) -> DataFrame:
    """Running counts of product interactions and of browsing signals."""
    w = Window.partitionBy(cols.session).orderBy("event_idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        flagged.withColumn("is_interaction", F.col(cols.product).isNotNull())
        .withColumn("is_signal", F.col("repeat_view") | F.col("category_switch"))
        .withColumn("interaction_no", F.sum(F.col("is_interaction").cast("bigint")).over(w))
        .withColumn("signal_no", F.sum(F.col("is_signal").cast("bigint")).over(w))
    )


def signalled_events(sessions: DataFrame, cols: EventColumns = EventColumns()) -> DataFrame:
    """Ordered events with browsing flags and running counts: one shuffle, by session."""
    ordered = order_events(sessions, cols)
    return running_ordinals(category_switch_flag(repeat_view_flag(ordered, cols), cols), cols)


def _triggers(cols: EventColumns) -> dict[str, Column]:
    kind = F.col(cols.kind)
    return {
        "_interaction2": first_index_where(F.col("is_interaction") & (F.col("interaction_no") == 2)),
        "_signal2": first_index_where(F.col("is_signal") & (F.col("signal_no") == 2)),
        "_cart": first_index_where(kind == "cart"),
        "_purchase": first_index_where(kind == "purchase"),
        "n_events": F.count(F.lit(1)),
    }


def _cut_columns() -> dict[str, Column]:
    s1, signal, cart, bought = (F.col(c) for c in ("_interaction2", "_signal2", "_cart", "_purchase"))
    last = F.coalesce(bought, F.col("n_events")) - 1
    s2 = F.when((signal > s1) & (cart.isNull() | (signal < cart)), signal)
    s3 = F.when(cart >= s1, cart)
    return {
        "label": bought.isNotNull(),
        "max_admissible_idx": last,
        "cut_S1": clip_before_purchase(s1, last),
        "cut_S2": clip_before_purchase(s2, last),
        "cut_S3": clip_before_purchase(s3, last),
        "cut_S4": F.coalesce(bought, F.col("n_events") - 1),
    }


def stage_cutpoints(sessions: DataFrame, cols: EventColumns = EventColumns()) -> DataFrame:
    """One row per session: label, last admissible index, cuts and reached flags."""
    per_session = signalled_events(sessions, cols).groupBy(cols.session).agg(
        *[c.alias(n) for n, c in _triggers(cols).items()]
    )
    cuts = per_session.withColumns(_cut_columns())
    return cuts.select(
        cols.session, "label", "n_events", "max_admissible_idx",
        *[f"cut_{s}" for s in STAGES],
        *[F.col(f"cut_{s}").isNotNull().alias(f"reached_{s}") for s in STAGES],
    )


def events_with_cuts(sessions: DataFrame, cols: EventColumns = EventColumns()) -> DataFrame:
    """Ordered events, each carrying its session's label and cuts.

    Same rules as :func:`stage_cutpoints`, attached by window instead of by a
    join back: the events are shuffled once and never twice.
    """
    whole = Window.partitionBy(cols.session)
    events = signalled_events(sessions, cols)
    events = events.withColumns({n: c.over(whole) for n, c in _triggers(cols).items()})
    return events.withColumns(_cut_columns()).drop(*_triggers(cols))


def prefix_events(
    sessions: DataFrame, cutpoints: DataFrame, stage: str, cols: EventColumns = EventColumns()
) -> DataFrame:
    """Events up to the stage cut, for sessions that reached the stage."""
    _check_model_stage(stage)
    cut = f"cut_{stage}"
    reached = cutpoints.where(F.col(cut).isNotNull()).select(cols.session, cut, "label")
    return order_events(sessions, cols).join(reached, cols.session).where(F.col("event_idx") <= F.col(cut))


def in_stages(events: DataFrame, stages=MODEL_STAGES) -> DataFrame:
    """One row per (event, stage prefix that holds it), with ``stage`` and ``cut``."""
    held = F.filter(
        F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"cut_{s}").alias("cut")) for s in stages]),
        lambda x: F.col("event_idx") <= x["cut"],
    )
    keep = [c for c in events.columns if not c.startswith("cut_")]
    return events.select(*keep, F.explode(held).alias("_s")).select(*keep, "_s.stage", "_s.cut")


def stage_prefixes(sessions: DataFrame, cols: EventColumns = EventColumns()) -> DataFrame:
    """All stage prefixes at once."""
    return in_stages(events_with_cuts(sessions, cols))


def whole_session_events(
    sessions: DataFrame, cutpoints: DataFrame, *, exclude_purchase: bool = False,
    cols: EventColumns = EventColumns(),
) -> DataFrame:
    """Every event with its session's label, with or without the purchases."""
    events = order_events(sessions, cols)
    if exclude_purchase:
        events = events.where(F.col(cols.kind) != "purchase")
    return events.join(cutpoints.select(cols.session, "label"), cols.session)


def stage_prevalence(cutpoints: DataFrame) -> DataFrame:
    """Sessions, reach rate, positives, prevalence and mean prefix length per stage."""
    stages = F.array(*[
        F.struct(F.lit(s).alias("stage"), F.lit(STAGE_TEXT[s]).alias("definition"),
                 F.lit(s in MODEL_STAGES).alias("modelled"), F.col(f"cut_{s}").alias("cut"))
        for s in STAGES
    ])
    reached = F.col("s.cut").isNotNull()
    return (
        cutpoints.select("label", F.explode(stages).alias("s"))
        .groupBy("s.stage", "s.definition", "s.modelled")
        .agg(
            F.count_if(reached).alias("n_sessions"),
            F.avg(reached.cast("int")).alias("reach_rate"),
            F.count_if(reached & F.col("label")).alias("n_positive"),
            F.avg(F.when(reached, F.col("label").cast("int"))).alias("prevalence"),
            F.avg(F.col("s.cut") + 1).alias("mean_prefix_events"),
        )
    )


def stage_distinctness(
    cutpoints: DataFrame, pairs=(("S1", "S2"), ("S2", "S3"))
) -> DataFrame:
    """How often two stages share a cut, among sessions that reach both."""
    both = F.filter(
        F.array(*[
            F.struct(F.lit(f"{a}->{b}").alias("pair"), (F.col(f"cut_{b}") - F.col(f"cut_{a}")).alias("extra"))
            for a, b in pairs
        ]),
        lambda x: x["pair"].isNotNull(),
    )
    return (
        cutpoints.select(F.explode(both).alias("p"))
        .groupBy("p.pair")
        .agg(
            F.count("p.extra").alias("n_sessions_reaching_both"),
            F.count_if(F.col("p.extra") == 0).alias("n_identical_cutpoint"),
            F.avg((F.col("p.extra") == 0).cast("int")).alias("share_identical"),
            F.avg("p.extra").alias("mean_extra_events"),
        )
    )
