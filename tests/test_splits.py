import datetime as dt

import pytest
from times import START
from pyspark.sql import functions as F

from wayfare.functions.ranks import hash_cut, hash_rank, running_totals
from wayfare.operators import splits


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for u in range(200):
        for s in range(1 + u % 3):
            rows.append((f"{u}_{s}", u, START + dt.timedelta(hours=u // 2 * 2 + s), (u + s) % 4 == 0))
    return spark.createDataFrame(rows, "session_id string, user_id long, session_start timestamp, label boolean")


def parts(split):
    return {r["user_id"]: r["partition"] for r in split.select("user_id", "partition").distinct().collect()}


def test_temporal_split_is_ordered_and_whole(table):
    split = splits.temporal_split(table)
    assert split.select("user_id", "partition").distinct().count() == split.select("user_id").distinct().count()
    edges = {r["partition"]: r for r in splits.temporal_boundaries(split).collect()}
    assert edges["train"]["last_start"] < edges["val"]["first_start"]
    assert edges["val"]["last_start"] < edges["test"]["first_start"]
    # two users share every first start: the boundaries are exact nevertheless
    kept = parts(split)
    assert sum(p == "test" for p in kept.values()) == 30
    assert splits.split_report(split).first()["n_sessions"] == split.count()


def test_temporal_split_with_one_shared_start(spark, table):
    same = table.withColumn("session_start", F.lit(START))
    split = splits.temporal_split(same)
    assert set(parts(split).values()) == {"test"}  # everyone else reaches the boundary
    with pytest.raises(splits.SplitError):
        splits.split_report(split)


def test_grouped_split_sizes_and_determinism(table):
    a = parts(splits.grouped_split(table))
    assert [sum(p == x for p in a.values()) for x in splits.PARTITIONS] == [140, 30, 30]
    assert a == parts(splits.grouped_split(table.orderBy(F.desc("session_id"))))
    assert a != parts(splits.grouped_split(table, seed=1))


def test_bad_ratios(table):
    with pytest.raises(splits.SplitError):
        splits.grouped_split(table, ratios=(0.5, 0.5, 0.5))


def test_frozen_split_is_not_replaced(spark, table, tmp_path):
    path = str(tmp_path / "split")
    splits.freeze_split(splits.grouped_split(table), path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        splits.freeze_split(splits.grouped_split(table), path)
    assert splits.load_split(spark, path).columns == ["session_id", "user_id", "partition", "label"]


def test_month_split(spark):
    sizes = dict(Feb=184, Mar=1907, May=3364, June=288, Jul=432, Aug=433, Sep=448, Oct=549, Nov=2998, Dec=1727)
    rows = [(m, "TRUE" if i % 7 == 0 else "FALSE") for m, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "Month string, Revenue string")
    split = splits.month_split(df)
    got = {r["Month"]: r["partition"] for r in split.select("Month", "partition").distinct().collect()}
    assert len(got) == 10  # a month has one partition
    cumulative, best = 0, None
    months, shares = list(sizes), []
    for m in months:
        cumulative += sizes[m]
        shares.append(cumulative / 12330)
    for i in range(1, 10):
        for j in range(i + 1, 10):
            cost = (shares[i - 1] - 0.7) ** 2 + (shares[j - 1] - 0.85) ** 2
            if best is None or cost < best[0]:
                best = (cost, i, j)
    want = {m: "train" if k < best[1] else "val" if k < best[2] else "test" for k, m in enumerate(months)}
    assert got == want
    with pytest.raises(splits.SplitError):
        splits.month_split(df.withColumn("Month", F.lit("Smarch")))


def test_subsample_properties(spark):
    rows = [(u, f"{u}_{s}", "view") for u in range(400) for s in range(3) for _ in range(2)]
    df = spark.createDataFrame(rows, "user_id long, session_id string, event_type string")
    small = splits.subsample_users(df, 50, min_sessions=0)
    large = splits.subsample_users(df, 120, min_sessions=0)
    users = lambda t: {r[0] for r in t.select("user_id").distinct().collect()}
    assert len(users(small)) == 50 and small.count() == 300 and users(small) < users(large)
    assert users(splits.subsample_users(df.orderBy(F.desc("user_id")), 50, min_sessions=0)) == users(small)
    assert splits.subsample_users(df, 9999, min_sessions=0).count() == df.count()
    with pytest.raises(splits.SubsampleError):
        splits.subsample_users(df, 50)


def test_stratified_slice_and_permutation(spark):
    rows = [("S1", f"s{i}", i % 5 == 0) for i in range(103)] + [("S2", f"s{i}", i == 0) for i in range(3)]
    df = spark.createDataFrame(rows, "stage string, session_id string, label boolean")
    sliced = splits.stratified_slice(df, 0.2, groups=["stage"]).where("in_slice").groupBy("stage", "label").count()
    assert {(r[0], r[1]): r[2] for r in sliced.collect()} == {
        ("S1", True): 4, ("S1", False): 16, ("S2", True): 1, ("S2", False): 1}
    mixed = splits.permute_labels(df, 3)
    assert mixed.count() == df.count()
    assert mixed.where("stage = 'S1' and label").count() == 21
    moved = mixed.withColumnRenamed("label", "new").join(df, ["stage", "session_id"]).where("new != label")
    assert moved.count() > 0


def test_common_cohort(spark):
    df = spark.createDataFrame([("a", s) for s in ("S1", "S2", "S3")] + [("b", "S1"), ("b", "S3")],
                               "session_id string, stage string")
    assert [r[0] for r in splits.common_cohort(df).collect()] == ["a"]


def test_rank_helpers(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 2)
    ranked = hash_rank(df, "id", 1, ["g"]).groupBy("g").agg(
        F.count_distinct("rank").alias("n"), F.max("rank").alias("top"))
    assert {tuple(r)[1:] for r in ranked.collect()} == {(2500, 2500)}
    cut = hash_cut(df, "id", 1, lambda n: F.lit(100), ["g"])
    both = hash_rank(df, "id", 1, ["g"]).join(cut, "g")
    inside = both.where(F.md5(F.concat(F.col("id").cast("string"), F.lit("|1"))) <= F.col("cut"))
    assert inside.agg(F.max("rank")).first()[0] == 100 and inside.count() == 200


@pytest.mark.parametrize("descending", [False, True])
def test_chunked_running_totals_equal_one_window(spark, descending):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 991).cast("double").alias("v"), (F.col("id") % 2).alias("g")
    ).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    one = running_totals(df, "v", ["n"], ["g"], descending=descending)
    many = running_totals(df, "v", ["n"], ["g"], descending=descending, rows_per_chunk=20)
    assert one.exceptAll(many).count() == 0 and many.count() == df.count()
