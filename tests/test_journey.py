"""Cleaning, sessions and cut-points: truth tables, quirks and the hot-user path."""

import datetime as dt

import pytest
from times import START
from pyspark.sql import functions as F

from wayfare.functions.columns import bool_from_text, parse_event_time
from wayfare.functions.ranks import nearest_quantile
from wayfare.operators import cleaning, sessions, stages
from wayfare.sources import tables
from wayfare.sources.schema import SchemaError, validate_columns

LOG = "user_id long, event_time timestamp, event_type string, product_id long, user_session string, seq long"


def log(spark, rows):
    return spark.createDataFrame([
        (u, None if t is None else START + dt.timedelta(minutes=t), k, p, s, i)
        for i, (u, t, k, p, s) in enumerate(rows)], LOG)


def cuts(table):
    return stages.stage_cutpoints(table).first()


@pytest.mark.parametrize("rows, expected", [
    ([(0, "p", 1, 1), (30, "v", 2, 1)], dict(max_admissible_idx=-1, cut_S1=None, cut_S2=None, cut_S3=None)),
    ([(0, "v", 1, 1), (30, "v", 2, 2), (60, "v", 3, 3)], dict(cut_S1=1, cut_S2=2, label=False)),
    ([(0, "v", 1, 1), (30, "p", 1, 1)], dict(cut_S1=None, label=True, cut_S4=1)),
    ([(0, "v", 1, 1), (30, "v", 2, 2), (60, "v", 2, 2)], dict(cut_S2=2)),
    ([(0, "v", 1, 1), (30, "v", 2, 2), (60, "c", 3, 3)], dict(cut_S2=None, cut_S3=2)),
    ([(0, "v", 1, 1), (30, "v", 2, 2)], dict(cut_S2=None, reached_S2=False, cut_S4=1)),
    ([(0, "v", 1, 1), (30, "c", 1, 1), (60, "p", 1, 1)], dict(cut_S1=1, cut_S3=1, label=True)),
    ([(0, "v", 1, 1), (15, "v", 2, 1), (30, "p", 1, 1), (60, "c", 2, 1)], dict(cut_S1=1, cut_S3=None)),
    # null products are no interaction, but a second null view is a repeat view
    ([(0, "v", None, 1), (5, "v", 1, 1), (9, "v", None, 1), (12, "v", 1, 1)], dict(cut_S1=3, cut_S2=None)),
])
def test_cutpoint_truth_table(journey, rows, expected):
    got = cuts(journey(*rows)).asDict()
    assert {k: got[k] for k in expected} == expected


def test_window_cuts_equal_aggregated_cuts(spark, journey):
    table = journey((0, "v", 1, 1), (30, "v", 2, 2), (60, "v", 2, 2), (61, "c", 4, 1), (70, "p", 4, 1))
    a = stages.stage_prefixes(table).select("stage", "event_idx", "label")
    b = None
    for s in stages.MODEL_STAGES:
        part = stages.prefix_events(table, stages.stage_cutpoints(table), s).select(
            F.lit(s).alias("stage"), "event_idx", "label")
        b = part if b is None else b.unionByName(part)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() > 0


def test_prefix_gate_refuses(journey):
    table = journey((0, "v", 1, 1), (1, "v", 2, 1))
    with pytest.raises(stages.StageError):
        stages.prefix_events(table, stages.stage_cutpoints(table), "S4")
    with pytest.raises(stages.StageError):
        stages.prefix_events(table, stages.stage_cutpoints(table), "S9")


def test_prevalence_and_distinctness(spark, journey):
    table = journey((0, "v", 1, 1), (30, "v", 2, 2), (60, "v", 2, 2), (90, "c", 2, 2)).unionByName(
        journey((0, "v", 1, 1), (30, "c", 2, 2), (60, "p", 2, 2), session="2_0"))
    cut = stages.stage_cutpoints(table)
    by = {r["stage"]: r for r in stages.stage_prevalence(cut).collect()}
    assert by["S1"]["n_sessions"] == 2 and by["S1"]["n_positive"] == 1
    assert by["S2"]["n_sessions"] == 1 and by["S2"]["prevalence"] == 0.0
    assert by["S3"]["mean_prefix_events"] == 3.0
    pairs = {r["pair"]: r for r in stages.stage_distinctness(cut, (("S1", "S3"), ("S2", "S3"))).collect()}
    assert pairs["S1->S3"]["n_identical_cutpoint"] == 1
    assert pairs["S2->S3"]["mean_extra_events"] == 1.0


def test_parse_event_time(spark):
    df = spark.createDataFrame([("2019-10-01 00:00:05 UTC",), ("2019-10-01 00:00:05",), ("bad",), (None,)], "event_time string")
    got = [r[0] for r in parse_event_time(df).select(F.unix_timestamp("event_time")).collect()]
    assert got == [1569888005, 1569888005, None, None]
    assert parse_event_time(parse_event_time(df)).schema == parse_event_time(df).schema


def test_clean_drops_bad_rows_and_copies(spark):
    rows = [(1, 0, "view", 5, "a"), (1, 0, "view", 5, "b"), (1, 1, "search", 5, "a"), (1, None, "view", 5, "a"),
            (1, 2, "view", 5, None), (2, 0, "view", 5, "a")]
    got = cleaning.clean_events(log(spark, rows)).orderBy("user_id").collect()
    assert [(r["user_id"], r["user_session"]) for r in got] == [(1, "a"), (2, "a")]  # the first copy survives


@pytest.mark.parametrize("gap, n", [(5, 3), (30, 2), (60, 1)])
def test_gap_lengths(spark, gap, n):
    rows = [(1, 0, "view", 1, "a"), (1, 10, "view", 2, "a"), (1, 55, "view", 3, "a")]
    found = sessions.assign_sessions(log(spark, rows), sessions.SessionRules(gap_minutes=gap))
    assert found.select("session_id").distinct().count() == n


def test_exact_gap_is_one_session_and_users_never_mix(spark):
    rows = [(1, 0, "view", 1, "a"), (1, 30, "view", 2, "a"), (2, 31, "view", 2, "a"), (None, 31, "view", 2, "a")]
    got = {(r["user_id"], r["session_id"]) for r in sessions.assign_sessions(log(spark, rows)).collect()}
    assert got == {(1, "1_1"), (2, "2_1"), (None, None)}


def test_hot_users_are_cut_the_same_way(spark):
    import random

    rng = random.Random(3)
    rows = [(u, rng.randrange(0, 5000), "view", i, "a") for i, u in enumerate(rng.choices([1, 1, 1, 2, 3, None], k=600))]
    events = log(spark, rows)
    plain = sessions.assign_sessions(events).select("seq", "session_id")
    long = sessions.SessionRules(chunk_seconds=10**9)
    short = sessions.SessionRules(chunk_seconds=70)
    assert sessions.assign_sessions(events, long).exceptAll(sessions.assign_sessions(events, short)).isEmpty()
    chunked = sessions.assign_sessions(events, sessions.SessionRules(chunk_seconds=1800)).select("seq", "session_id")
    assert plain.exceptAll(chunked).count() == 0 and chunked.count() == 600


def test_a_burst_is_counted_without_ordering_its_events(spark):
    events = spark.range(40_000).select(
        F.lit(1).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 60 + F.when(F.col("id") == 7, 9_000).otherwise(0)).alias("event_time"),
        F.col("id").alias("seq"))
    got = sessions.assign_sessions(events)
    assert {(r[0], r[1]) for r in got.groupBy("session_id").count().collect()} == {("1_1", 39_999), ("1_2", 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("_chunk" in line for line in plan.splitlines() if "Window" in line)
    assert plan.index("Window") < plan.index("Aggregate")  # ordered are the ends of chunks, not the events


def test_filter_keeps_middle_lengths(spark):
    rows, u = [], 0
    for size in [1] * 5 + [2, 3] * 150 + [400]:
        u += 1
        rows += [(u, i, "view", i, "a") for i in range(size)]
    assigned = sessions.assign_sessions(log(spark, rows))
    kept = sessions.filter_sessions(assigned).groupBy("session_id").count()
    assert sorted(r[0] for r in kept.select("count").distinct().collect()) == [2, 3]
    assert kept.count() == 300


def test_rules_reject_bad_settings():
    with pytest.raises(ValueError):
        sessions.SessionRules(gap_minutes=0)
    with pytest.raises(ValueError):
        sessions.SessionRules(percentile=0.4)


def test_nearest_quantile_matches_sorted_pick(spark):
    import random

    rng = random.Random(1)
    for n in (1, 2, 7, 200, 1001):
        values = [rng.randrange(0, 100_000) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v long")
        for q in (0.5, 0.995):
            want = sorted(values)[int((n - 1) * q + 0.5)]
            assert nearest_quantile(df, "v", q, "x", width=50).first()["x"] == want


def test_agreement(spark):
    rows = [(1, 0, "view", 1, "a"), (1, 1, "view", 2, "a"), (1, 2, "view", 3, "b"), (1, 500, "view", 3, "b")]
    row = sessions.session_agreement(sessions.assign_sessions(log(spark, rows))).first()
    assert (row["agreement"], row["n_derived"], row["n_provided"]) == (0.75, 2, 2)


def test_schema_checks_and_io(spark, tmp_path):
    with pytest.raises(SchemaError):
        validate_columns(["event_time"])
    bad = str(tmp_path / "bad.csv")
    spark.createDataFrame([(1,)], "user_id int").write.option("header", True).csv(bad)
    with pytest.raises(SchemaError):
        tables.scan_events(spark, bad)
    good = str(tmp_path / "log.csv")
    events = log(spark, [(1, 0, "view", 1, "a"), (1, 1, "cart", 2, "a")]).drop("seq")
    tables.write_table(events, good)
    out = tables.csv_to_parquet(spark, good, str(tmp_path / "log.parquet"))
    assert out.count() == 2 and dict(out.dtypes)["event_time"] == "string"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.csv_to_parquet(spark, good, str(tmp_path / "log.parquet"))
    scanned = tables.scan_events(spark, str(tmp_path / "log.parquet"))
    assert "seq" in scanned.columns
    sized = tables.input_bytes(spark.read.parquet(str(tmp_path / "log.parquet"))).first()
    assert sized["n_bytes"] > 0
    a, b = tables.table_audit(events).first(), tables.table_audit(events.orderBy(F.desc("product_id"))).first()
    assert a == b and a["n_rows"] == 2


def test_bool_from_text(spark):
    df = spark.createDataFrame([("TRUE",), ("true",), ("FALSE",), (None,)], "x string")
    assert [r[0] for r in df.select(bool_from_text(F.col("x"))).collect()] == [1, 1, 0, 0]


def test_copies_with_null_keys_are_equal(spark):
    rows = [(None, 0, "view", None, "a"), (None, 0, "view", None, "b"), (1, 0, "view", None, "c"), (1, 0, "view", None, "d"),
            (1, 0, "view", 3, "e")] + [(2, 5, "view", 9, "z")] * 500
    got = sorted(r["seq"] for r in cleaning.dedup_events(log(spark, rows)).collect())
    assert got == [0, 2, 4, 5]


def test_clean_plan_does_not_shuffle_full_rows(spark, journey):
    table = journey((0, "v", 1, 1), (30, "v", 2, 2)).withColumn("user_session", F.lit("a"))
    plan = cleaning.clean_events(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_features_use_one_shuffle(spark, journey):
    from wayfare.operators.features import stage_features

    table = journey((0, "v", 1, 1), (30, "v", 2, 2))
    plan = stage_features(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
