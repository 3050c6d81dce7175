"""Event-log and static-table readers, table writers and the input audit."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import (
    EVENT_SCHEMA,
    STATIC_CATEGORICAL,
    STATIC_NUMERIC,
    STATIC_ROWS,
    STATIC_SCHEMA,
    STATIC_TARGET,
    SchemaError,
    validate_columns,
)


def _csv_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def _csv_schema(columns, known):
    types = {f.name: f.dataType.simpleString() for f in known}
    return ", ".join(f"`{c}` {types.get(c, 'string')}" for c in columns)


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files with an explicit source order in ``seq``.

    Parquet keeps ``(file, row)``; CSV rows keep file, start of their split and
    place in it, which sort by file and position however files are split.
    """
    if path.endswith((".csv", ".csv.gz", ".csv/")):
        columns = _csv_columns(spark, path)
        validate_columns(columns)
        events = (
            spark.read.option("header", True)
            .schema(_csv_schema(columns, EVENT_SCHEMA))
            .csv(path)
        )
        return events.select("*", F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row")).alias("seq"))
    events = spark.read.parquet(path)
    validate_columns(events.columns)
    if "seq" in events.columns:
        return events
    return events.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("seq"),
    )


def csv_to_parquet(
    spark: SparkSession, source: str, dest: str, *, overwrite: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Convert an event CSV (plain or gzip) to zstd Parquet.

    A gzip file is one split, so the rows are spread right after the read;
    ``seq`` is fixed before the spread and kept.
    """
    events = scan_events(spark, source)
    if source.endswith(".gz") or partitions:
        events = events.repartition(partitions or spark.sparkContext.defaultParallelism * 4, "seq")
    mode = "overwrite" if overwrite else "errorifexists"
    events.write.mode(mode).option("compression", "zstd").parquet(dest)
    table = spark.read.parquet(dest)
    if table.isEmpty():
        raise SchemaError(f"{source} produced no rows")
    return table


def scan_static(spark: SparkSession, path: str, expected_rows: int | None = STATIC_ROWS) -> DataFrame:
    """Static session CSV: numeric columns pinned to double, row count checked."""
    columns = _csv_columns(spark, path)
    validate_columns(columns, (*STATIC_NUMERIC, *STATIC_CATEGORICAL, STATIC_TARGET))
    table = (
        spark.read.option("header", True).schema(_csv_schema(columns, STATIC_SCHEMA)).csv(path)
    )
    if expected_rows is not None:
        rows = table.count()
        if rows != expected_rows:
            warnings.warn(f"static table has {rows} rows, expected {expected_rows}", stacklevel=2)
    return table


def table_audit(df: DataFrame, columns=None) -> DataFrame:
    """Row count and an order-free digest of the named columns.

    The digest is the XOR of the leading 60 bits of each row's MD5, so it does
    not depend on row order or partitioning. Null is written as an empty field
    with its own mark so that it differs from an empty string.
    """
    columns = list(columns or df.columns)
    text = F.concat_ws(
        "|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    )
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(bits).alias("digest"))


def input_bytes(df: DataFrame) -> DataFrame:
    """Number and total size of the files behind a file-based table."""
    files = df.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
    ).groupBy("file").agg(F.max("size").alias("size"))
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


def write_table(df: DataFrame, path: str, *, mode: str = "errorifexists", partition_by=()) -> str:
    """Write Parquet, or CSV with a header when the path ends in ``.csv``."""
    writer = df.write.mode(mode)
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return path


def read_cached_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Re-open a written table by its suffix."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path)
