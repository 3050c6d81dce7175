"""Column layout of the event log and of the static session table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Column names and vocabulary of the two input tables.
REQUIRED_COLUMNS = ("event_time", "event_type", "product_id", "user_id", "user_session")
OPTIONAL_COLUMNS = ("category_id", "category_code", "brand", "price")
CRITICAL_COLUMNS = ("user_session", "event_time", "event_type")
EVENT_TYPES = ("view", "cart", "remove_from_cart", "purchase")
STATIC_NUMERIC = (
    "Administrative", "Administrative_Duration", "Informational", "Informational_Duration",
    "ProductRelated", "ProductRelated_Duration", "BounceRates", "ExitRates", "PageValues",
    "SpecialDay",
)
STATIC_CATEGORICAL = (
    "Month", "OperatingSystems", "Browser", "Region", "TrafficType", "VisitorType", "Weekend",
)
STATIC_TARGET = "Revenue"
STATIC_ROWS = 12_330
STATIC_MONTHS = ("Feb", "Mar", "May", "June", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

EVENT_SCHEMA = T.StructType([
    T.StructField("event_time", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("category_code", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("user_session", T.StringType()),
])

STATIC_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in STATIC_NUMERIC]
    + [T.StructField(c, T.StringType()) for c in (*STATIC_CATEGORICAL, STATIC_TARGET)]
)


class SchemaError(ValueError):
    """An input table lacks a column it must have."""


@dataclass(frozen=True)
class EventColumns:
    """Names of the columns the journey operators read."""

    user: str = "user_id"
    session: str = "session_id"
    time: str = "event_time"
    kind: str = "event_type"
    product: str = "product_id"
    category: str = "category_id"
    price: str = "price"
    order: str = "seq"


def validate_columns(columns, required=REQUIRED_COLUMNS) -> None:
    missing = [c for c in required if c not in columns]
    if missing:
        raise SchemaError(f"missing required columns {missing}; got {sorted(columns)}")
