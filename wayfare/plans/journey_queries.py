"""Queries over sources, cleaning, sessions, stages and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import clip_before_purchase, first_index_where
from ..functions.columns import parse_event_time as parse_time
from ..functions.ranks import nearest_quantile
from ..operators import cleaning, features, sessions, stages
from ..session import materialise, new_path
from ..sources import tables
from ..sources.provided import provided_static
from ..sources.schema import REQUIRED_COLUMNS, SchemaError, validate_columns
from .artefacts import RULES, Artefacts
from .registry import ntz, query, r, rounded

_EVENT = "seq, user_id, event_time, event_type, product_id, category_id, price, user_session"


# sources and sinks ----------------------------------------------------------
@query("scan_events", f"SELECT {_EVENT} FROM j_events")
def _(a: Artefacts):
    path = materialise(a.events, "log").inputFiles()[0].rsplit("/", 1)[0]
    return ntz(tables.scan_events(a.spark, path))


@query("csv_to_parquet", f"""SELECT {_EVENT.replace('seq, ', '').replace('event_time',
    "strftime(event_time, '%Y-%m-%d %H:%M:%S') || ' UTC' AS event_time")} FROM j_events""")
def _(a: Artefacts):
    source = new_path(a.spark, "log") + ".csv"
    text = F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    tables.write_table(a.events.drop("seq").withColumn("event_time", text), source)
    dest = new_path(a.spark, "converted")
    return tables.csv_to_parquet(a.spark, source, dest).drop("seq")


_STATIC = [
    "Administrative", "Administrative_Duration", "Informational", "Informational_Duration",
    "ProductRelated", "ProductRelated_Duration", "BounceRates", "ExitRates", "PageValues", "SpecialDay",
]
_KINDS = ["Month", "OperatingSystems", "Browser", "Region", "TrafficType", "VisitorType"]


@query("scan_static", f"""SELECT session_id, {r(*_STATIC)}, {', '.join(f'"{c}"' for c in _KINDS)},
    "Weekend", "Revenue" FROM j_static""")
def _(a: Artefacts):
    path = new_path(a.spark, "static") + ".csv"
    tables.write_table(a.static, path)
    return rounded(tables.scan_static(a.spark, path, expected_rows=None))


@query("validate_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_present FROM j_events"
    for c in REQUIRED_COLUMNS))
def _(a: Artefacts):
    validate_columns(a.events.columns)
    try:
        validate_columns([c for c in a.events.columns if c != "product_id"])
    except SchemaError:
        pass
    else:
        raise AssertionError("a missing column went unnoticed")
    present = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).isNotNull().alias("here")) for c in REQUIRED_COLUMNS])
    return a.events.select(F.explode(present).alias("p")).groupBy("p.column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("p.here").alias("n_present"))


# All columns; times as microseconds and prices as hundredths, whose text is the same in every engine.
_AUDITED = ["seq", "user_id", "event_time", "event_type", "product_id", "category_id", "price", "user_session"]
_AUDITED_SQL = " || '|' || ".join(
    "coalesce('=' || " + {"event_time": "epoch_us(event_time)", "price": "CAST(round(price * 100) AS BIGINT)"}.get(c, c) + ", '~')"
    for c in _AUDITED)


@query("table_audit", f"""
    SELECT count(*) AS n_rows, bit_xor(CAST('0x' || substr(md5({_AUDITED_SQL}), 1, 15) AS BIGINT)) AS digest FROM j_events""")
def _(a: Artefacts):
    exact = a.events.withColumns({
        "event_time": F.unix_micros(F.col("event_time").cast("timestamp")), "price": F.round(F.col("price") * 100).cast("bigint")})
    return tables.table_audit(exact, _AUDITED)


@query("write_table", """
    SELECT session_id, label, n_events, "cut_S1", "cut_S2", "cut_S3", "cut_S4" FROM j_cuts""")
def _(a: Artefacts):
    cuts = a.cutpoints.select("session_id", "label", "n_events", *[f"cut_{s}" for s in stages.STAGES])
    path = tables.write_table(cuts, new_path(a.spark, "cuts") + ".csv")
    return tables.read_cached_table(a.spark, path, cuts.schema)


@query("read_cached_table", """
    SELECT session_id, label, n_events, "cut_S1", "cut_S2", "cut_S3", "cut_S4" FROM j_cuts""")
def _(a: Artefacts):
    cuts = a.cutpoints.select("session_id", "label", "n_events", *[f"cut_{s}" for s in stages.STAGES])
    return tables.read_cached_table(a.spark, tables.write_table(cuts, new_path(a.spark, "cuts")))


def _feature_set_sql() -> str:
    parts = []
    for stage in stages.MODEL_STAGES:
        for name in features.FEATURE_SETS:
            cols = features.feature_names(stage, name)
            total = " + ".join(f"round({c}, 3)" for c in cols)
            parts.append(f"SELECT '{stage}' AS stage, '{name}' AS feature_set, {len(cols)} AS n_features, "
                         f"count(*) AS n_rows, round(sum({total}), 1) AS total FROM j_feats WHERE stage = '{stage}'")
    return " UNION ALL ".join(parts)


@query("feature_sets", _feature_set_sql())
def _(a: Artefacts):
    out = None
    for stage in stages.MODEL_STAGES:
        for name in features.FEATURE_SETS:
            cols = features.feature_names(stage, name)
            total = sum((F.round(c, 3) for c in cols), F.lit(0.0))
            part = a.features.where(F.col("stage") == stage).select("session_id", *cols).agg(
                F.lit(stage).alias("stage"), F.lit(name).alias("feature_set"),
                F.lit(len(cols)).alias("n_features"), F.count(F.lit(1)).alias("n_rows"),
                F.round(F.sum(total), 1).alias("total"))
            out = part if out is None else out.unionByName(part)
    return out


# cleaning ---------------------------------------------------------------------
@query("parse_event_time", """
    SELECT seq, CASE WHEN seq % 97 <> 0 THEN date_trunc('second', event_time) END AS event_time
    FROM j_events""")
def _(a: Artefacts):
    text = F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    bad = F.concat(F.lit("at "), text)
    raw = a.events.select("seq", F.when(F.col("seq") % 97 != 0, text).otherwise(bad).alias("event_time"))
    return ntz(parse_time(raw))


@query("clean_events", f"SELECT {_EVENT} FROM j_clean")
def _(a: Artefacts):
    return ntz(cleaning.clean_events(a.events))


@query("dedup_events", """
    SELECT * FROM (SELECT seq, user_id, date_trunc('day', event_time) AS event_time, event_type,
      product_id % 4 AS product_id, price FROM j_events)
    QUALIFY row_number() OVER (PARTITION BY user_id, event_time, event_type, product_id ORDER BY seq) = 1""")
def _(a: Artefacts):
    coarse = a.events.select(
        "seq", "user_id", F.date_trunc("day", "event_time").alias("event_time"), "event_type",
        (F.col("product_id") % 4).alias("product_id"), "price")
    return ntz(cleaning.dedup_events(coarse))


@query("data_flow", """
    SELECT position, step, rule, n_events, n_sessions,
      coalesce(lag(n_events) OVER (ORDER BY position) - n_events, 0) AS events_removed,
      lag(n_sessions) OVER (ORDER BY position) - n_sessions AS sessions_removed
    FROM (
      SELECT 1 AS position, 'read' AS step, 'all rows of the log' AS rule,
        count(*) AS n_events, CAST(NULL AS BIGINT) AS n_sessions FROM j_events UNION ALL
      SELECT 2, 'valid', 'required columns filled, type among the known ones', count(*), NULL
        FROM j_valid UNION ALL
      SELECT 3, 'distinct', 'first of the rows that agree in user, time, type and product', count(*), NULL
        FROM j_clean UNION ALL
      SELECT 4, 'in sessions', 'a new session after 1440 idle minutes', count(*), count(DISTINCT session_id)
        FROM j_assigned UNION ALL
      SELECT 5, 'in kept sessions', 'at least 2 events; at most ' || max(cap_events)
        || ' events and ' || max(cap_duration_s) || ' seconds, the 0.995 quantiles', count(*),
        count(DISTINCT session_id) FROM j_sessions, j_caps)""")
def _(a: Artefacts):
    return cleaning.flow_table(
        a.events, a.stats, sessions.length_caps(a.stats, RULES), gap_minutes=RULES.gap_minutes,
        min_events=RULES.min_events, percentile=RULES.percentile)


@query("bool_from_text", """
    SELECT session_id, CAST("Weekend" = 'TRUE' AS TINYINT) AS weekend,
      CAST("Revenue" = 'TRUE' AS TINYINT) AS revenue FROM j_static""")
def _(a: Artefacts):
    return a.static.select(
        "session_id", cleaning.bool_from_text(F.lower("Weekend")).alias("weekend"),
        cleaning.bool_from_text(F.col("Revenue") == "TRUE").alias("revenue"))


@query("prepare_static", f"""
    SELECT session_id, {r(*_STATIC)}, {', '.join(f'"{c}"' for c in _KINDS)},
      CAST("Weekend" = 'TRUE' AS TINYINT) AS "Weekend", CAST("Revenue" = 'TRUE' AS TINYINT) AS label
    FROM j_static""")
def _(a: Artefacts):
    return rounded(cleaning.prepare_static(provided_static(a.spark, a.folder)))


@query("describe_static", """
    SELECT count(*) AS n_sessions, CAST(17 AS BIGINT) AS n_features,
      count(*) FILTER ("Revenue" = 'TRUE') AS n_positive,
      round(avg(CAST("Revenue" = 'TRUE' AS INT)), 6) AS prevalence FROM j_static""")
def _(a: Artefacts):
    return rounded(cleaning.describe_static(a.static))


# sessions ---------------------------------------------------------------------
@query("assign_sessions", "SELECT seq, user_id, session_id FROM j_assigned")
def _(a: Artefacts):
    return sessions.assign_sessions(cleaning.clean_events(a.events), RULES).select(
        "seq", "user_id", "session_id")


@query("session_stats", "SELECT session_id, n_events, duration_s FROM j_stats")
def _(a: Artefacts):
    return sessions.session_stats(a.assigned)


@query("nearest_quantile", "SELECT CAST(cap_events AS BIGINT) AS cap_events, CAST(cap_duration_s AS BIGINT) AS cap_duration_s FROM j_caps")
def _(a: Artefacts):
    enough = a.stats.where(F.col("n_events") >= RULES.min_events)
    return nearest_quantile(enough, "n_events", RULES.percentile, "cap_events").crossJoin(
        nearest_quantile(enough, "duration_s", RULES.percentile, "cap_duration_s"))


@query("filter_sessions", "SELECT session_id, seq FROM j_sessions")
def _(a: Artefacts):
    return sessions.filter_sessions(a.assigned, RULES).select("session_id", "seq")


@query("sessionize", f"SELECT {_EVENT}, session_id FROM j_sessions")
def _(a: Artefacts):
    return ntz(sessions.sessionize(a.events, RULES))


def _gap_sql() -> str:
    parts = []
    for g in sessions.SENSITIVITY_GAPS:
        us = g * 60_000_000
        parts.append(f"""
          SELECT {g} AS gap_minutes, (SELECT count(*) FROM st) AS n_sessions, count(*) AS n_kept,
            CAST(sum(n) AS BIGINT) AS n_events_kept, CAST(any_value(ce) AS BIGINT) AS cap_events,
            CAST(any_value(cd) AS BIGINT) AS cap_duration_s
          FROM (SELECT *, max(n) FILTER (rn = floor((t - 1) * 0.995 + 0.5)) OVER () AS ce,
              max(d) FILTER (rd = floor((t - 1) * 0.995 + 0.5)) OVER () AS cd
            FROM (SELECT n, d, row_number() OVER (ORDER BY n) - 1 AS rn,
              row_number() OVER (ORDER BY d) - 1 AS rd, count(*) OVER () AS t FROM st WHERE n >= 2))
          WHERE n <= ce AND d <= cd""".replace(" st", f" (SELECT user_id, s, count(*) AS n, CAST(floor((max(epoch_us(event_time)) - min(epoch_us(event_time))) / 1e6) AS BIGINT) AS d FROM (SELECT *, sum(CASE WHEN gap_us <= {us} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_time, seq) AS s FROM j_gaps) GROUP BY 1, 2)"))
    return " UNION ALL ".join(parts)


@query("gap_sensitivity", _gap_sql())
def _(a: Artefacts):
    return sessions.gap_sensitivity(a.events, rules=RULES)


@query("session_agreement", """
    SELECT round(CAST(sum(top) AS DOUBLE) / sum(n), 6) AS agreement, count(*) AS n_derived,
      (SELECT count(DISTINCT user_session) FROM j_assigned) AS n_provided
    FROM (SELECT session_id, max(n) AS top, sum(n) AS n FROM (
      SELECT session_id, user_session, count(*) AS n FROM j_assigned GROUP BY 1, 2) GROUP BY 1)""")
def _(a: Artefacts):
    return rounded(sessions.session_agreement(a.assigned))


# stages -------------------------------------------------------------------------
@query("order_events", "SELECT session_id, seq, event_idx FROM j_ordered")
def _(a: Artefacts):
    return stages.order_events(a.sessions).select("session_id", "seq", "event_idx")


@query("first_index_where", """
    SELECT session_id, min(event_idx) FILTER (event_type = 'view') AS first_view,
      min(event_idx) FILTER (event_type = 'cart') AS first_cart,
      min(event_idx) FILTER (event_type = 'purchase') AS first_purchase FROM j_ordered GROUP BY 1""")
def _(a: Artefacts):
    kind = F.col("event_type")
    return stages.order_events(a.sessions).groupBy("session_id").agg(*[
        first_index_where(kind == k).alias(f"first_{k}") for k in ("view", "cart", "purchase")])


@query("repeat_view_flag", "SELECT session_id, event_idx, repeat_view FROM j_flags")
def _(a: Artefacts):
    return stages.repeat_view_flag(stages.order_events(a.sessions)).select(
        "session_id", "event_idx", "repeat_view")


@query("category_switch_flag", "SELECT session_id, event_idx, category_switch FROM j_flags")
def _(a: Artefacts):
    return stages.category_switch_flag(stages.order_events(a.sessions)).select(
        "session_id", "event_idx", "category_switch")


@query("running_ordinals", "SELECT session_id, event_idx, interaction_no, signal_no FROM j_ordinals")
def _(a: Artefacts):
    return stages.signalled_events(a.sessions).select(
        "session_id", "event_idx", "interaction_no", "signal_no")


_CUTS = '"cut_S1", "cut_S2", "cut_S3", "cut_S4"'


@query("stage_cutpoints", f"""
    SELECT session_id, label, n_events, max_admissible_idx, {_CUTS},
      "cut_S1" IS NOT NULL AS "reached_S1", "cut_S2" IS NOT NULL AS "reached_S2",
      "cut_S3" IS NOT NULL AS "reached_S3", "cut_S4" IS NOT NULL AS "reached_S4" FROM j_cuts""")
def _(a: Artefacts):
    return stages.stage_cutpoints(a.sessions)


@query("clip_before_purchase", """
    SELECT session_id, CASE WHEN cart <= coalesce(bought, n_events) - 1 THEN cart END AS clipped_cart
    FROM j_firsts""")
def _(a: Artefacts):
    kind = F.col("event_type")
    firsts = stages.order_events(a.sessions).groupBy("session_id").agg(
        first_index_where(kind == "cart").alias("cart"),
        first_index_where(kind == "purchase").alias("bought"), F.count(F.lit(1)).alias("n"))
    return firsts.select("session_id", clip_before_purchase(
        F.col("cart"), F.coalesce("bought", "n") - 1).alias("clipped_cart"))


@query("prefix_events", "SELECT stage, session_id, event_idx, cut, label FROM j_prefix")
def _(a: Artefacts):
    out = None
    for s in stages.MODEL_STAGES:
        part = stages.prefix_events(a.sessions, a.cutpoints, s).select(
            F.lit(s).alias("stage"), "session_id", "event_idx", F.col(f"cut_{s}").alias("cut"), "label")
        out = part if out is None else out.unionByName(part)
    return out


@query("stage_prefixes", "SELECT stage, session_id, event_idx, cut, label FROM j_prefix")
def _(a: Artefacts):
    return stages.stage_prefixes(a.sessions).select("stage", "session_id", "event_idx", "cut", "label")


def _prevalence_sql(extra: str = "") -> str:
    text = " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in stages.STAGE_TEXT.items())
    return f"""
      SELECT stage, CASE stage {text} END AS definition, stage <> 'S4' AS modelled,
        count(cut) AS n_sessions, round(avg(CAST(cut IS NOT NULL AS INT)), 6) AS reach_rate,
        count(*) FILTER (cut IS NOT NULL AND label) AS n_positive,
        round(avg(CAST(label AS INT)) FILTER (cut IS NOT NULL), 6) AS prevalence,
        round(avg(cut + 1), 6) AS mean_prefix_events {extra}
      FROM j_stage_cuts GROUP BY stage"""


@query("stage_prevalence", _prevalence_sql())
def _(a: Artefacts):
    return rounded(stages.stage_prevalence(stages.stage_cutpoints(a.sessions)))


@query("dataset_statistics", _prevalence_sql(
    ", round(CAST(count(cut) AS DOUBLE) / (SELECT count(*) FROM j_events), 6) AS share_of_corpus"))
def _(a: Artefacts):
    from ..operators.decisions import dataset_statistics

    total = a.events.agg(F.count(F.lit(1)).alias("n"))
    return rounded(dataset_statistics(stages.stage_prevalence(a.cutpoints), total))


def _distinct_sql(x: str, y: str) -> str:
    return f"""
      SELECT '{x}->{y}' AS pair, count(*) AS n_sessions_reaching_both,
        count(*) FILTER ("cut_{x}" = "cut_{y}") AS n_identical_cutpoint,
        round(avg(CAST("cut_{x}" = "cut_{y}" AS INT)), 6) AS share_identical,
        round(avg("cut_{y}" - "cut_{x}"), 6) AS mean_extra_events
      FROM j_cuts WHERE "cut_{x}" IS NOT NULL AND "cut_{y}" IS NOT NULL"""


_PAIRS = (("S1", "S2"), ("S2", "S3"), ("S1", "S3"))


@query("stage_distinctness", " UNION ALL ".join(_distinct_sql(x, y) for x, y in _PAIRS))
def _(a: Artefacts):
    return rounded(stages.stage_distinctness(a.cutpoints, _PAIRS))


@query("whole_session_events", """
    SELECT o.session_id, event_idx, event_type, label FROM j_ordered o
    JOIN j_cuts c ON o.session_id = c.session_id WHERE event_type <> 'purchase'""")
def _(a: Artefacts):
    return stages.whole_session_events(a.sessions, a.cutpoints, exclude_purchase=True).select(
        "session_id", "event_idx", "event_type", "label")


# features -----------------------------------------------------------------------
_FEATURE_QUERIES = {
    "f_n_events": ("n_events",),
    "f_n_views": ("n_views",),
    "f_n_unique_products": ("n_unique_products",),
    "f_n_unique_categories": ("n_unique_categories",),
    "f_prefix_duration_s": ("prefix_duration_s",),
    "f_inter_event_mean_s": ("inter_event_mean_s",),
    "f_inter_event_std_s": ("inter_event_std_s",),
    "f_last_gap_s": ("last_gap_s",),
    "f_hour_of_day": ("hour_of_day",),
    "f_is_weekend": ("is_weekend",),
    "f_dwell_total_s": ("dwell_total_s",),
    "f_dwell_mean_product_s": ("dwell_mean_product_s",),
    "f_events_per_active_minute": ("events_per_active_minute",),
    "f_click_velocity": ("click_velocity",),
    "f_category_entropy": ("category_entropy",),
    "f_category_entropy_normalised": ("category_entropy_normalised",),
    "f_n_category_transitions": ("n_category_transitions",),
    "f_distinct_transition_rate": ("distinct_transition_rate",),
    "f_category_revisit_rate": ("category_revisit_rate",),
    "f_product_revisit_rate": ("product_revisit_rate",),
    "f_purchase_intent_score": ("purchase_intent_score",),
    "f_price_mean": ("price_mean",),
    "f_price_max": ("price_max",),
}


def _register_feature(name: str, columns: tuple[str, ...]) -> None:
    @query(name, f"SELECT session_id, stage, label, {r(*columns)} FROM j_feats")
    def _(a: Artefacts):
        return rounded(a.features.select("session_id", "stage", "label", *columns))


for _name, _columns in _FEATURE_QUERIES.items():
    _register_feature(_name, _columns)


@query("stage_features", f"SELECT session_id, stage, label, {r(*features.ALL_FEATURES, digits=4)} FROM j_feats")
def _(a: Artefacts):
    return rounded(features.stage_features(a.sessions), 4)


@query("build_stage_features", f"""SELECT session_id, label, {r(*features.feature_names('S2'), digits=4)}
    FROM j_feats WHERE stage = 'S2'""")
def _(a: Artefacts):
    prefix = stages.prefix_events(a.sessions, a.cutpoints, "S2")
    return rounded(features.build_stage_features(prefix, "S2"), 4)


from .sql_text import _feature_ctes, cte  # noqa: E402

cte("k_whole", """
    SELECT o.*, 'W' AS stage, c.label FROM j_ordered o JOIN j_cuts c ON o.session_id = c.session_id
    WHERE event_type <> 'purchase'""")
_feature_ctes("k", "k_whole")


@query("whole_session_features", f"""
    SELECT session_id, label, {r(*features.feature_names('S3'), digits=4)} FROM k_feats""")
def _(a: Artefacts):
    return rounded(features.whole_session_features(a.sessions, exclude_purchase=True), 4)


