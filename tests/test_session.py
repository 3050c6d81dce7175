"""Written tables."""

import os

from wayfare.session import discard, materialise


def test_a_written_table_can_go(spark):
    table = materialise(spark.range(5), "going")
    path = table._written_at.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    discard(table)
    discard(table)
    discard(spark.range(3))
    discard(None)
    assert not os.path.exists(path)


def test_a_shuffle_of_any_size_is_cut_into_bounded_tasks(spark):
    """Four shuffle partitions do not mean four tasks that grow with the input."""
    rows = spark.range(1_500_000, numPartitions=4).selectExpr("id % 5000 as k", "id", "sha2(cast(id as string), 512) as t")
    ranked = rows.selectExpr("k", "t", "row_number() over (partition by k order by id) as r")
    assert ranked.rdd.getNumPartitions() > 8
    few = spark.range(100).selectExpr("id % 5 as k", "row_number() over (partition by id % 5 order by id) as r")
    assert few.rdd.getNumPartitions() <= 8
