"""Adapters from the provided tables to the event log and the static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How the provided event kinds stand for journey kinds.
KIND_OF = {
    "view": "view",
    "click": "view",
    "signup": "cart",
    "error": "remove_from_cart",
    "purchase": "purchase",
}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def provided_events(spark: SparkSession, folder: str) -> DataFrame:
    """The provided ``events`` table in event-log layout."""
    raw = spark.read.parquet(f"{folder}/events.parquet")
    kinds = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])
    k = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select(
        F.col("event_id").alias("seq"),
        "user_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        kinds[F.col("event_type")].alias("event_type"),
        (k % 40).alias("product_id"),
        (k % 8).alias("category_id"),
        F.col("value").alias("price"),
        F.concat(
            F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")
        ).alias("user_session"),
    )


def provided_static(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with per-order line sums in static-session layout."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    lines = (
        spark.read.parquet(f"{folder}/lineitem.parquet")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("Administrative"),
            F.sum("l_quantity").alias("Administrative_Duration"),
            F.count_if(F.col("l_returnflag") == "R").cast("double").alias("Informational"),
            F.max("l_quantity").alias("Informational_Duration"),
            F.count_if(F.col("l_linestatus") == "O").cast("double").alias("ProductRelated"),
            F.max("l_extendedprice").alias("ProductRelated_Duration"),
            F.min("l_discount").alias("BounceRates"),
            F.max("l_tax").alias("ExitRates"),
            F.max("l_discount").alias("SpecialDay"),
        )
    )
    flag = lambda c: F.when(c, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    return orders.join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").cast("string").alias("session_id"),
        "Administrative", "Administrative_Duration", "Informational", "Informational_Duration",
        "ProductRelated", "ProductRelated_Duration", "BounceRates", "ExitRates",
        F.col("o_totalprice").alias("PageValues"),
        "SpecialDay",
        F.date_format("o_orderdate", "MMM").alias("Month"),
        F.col("o_orderpriority").alias("OperatingSystems"),
        (F.col("o_custkey") % 4).cast("string").alias("Browser"),
        (F.col("o_custkey") % 25).cast("string").alias("Region"),
        (F.col("o_orderkey") % 20).cast("string").alias("TrafficType"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("new")).otherwise(F.lit("returning"))
        .alias("VisitorType"),
        flag(F.weekday("o_orderdate") >= 5).alias("Weekend"),
        flag(F.col("o_orderstatus") == "F").alias("Revenue"),
    )
