"""Session settings and tables that cut lineage.

Intermediate results that several jobs read are written as Parquet under the
folder the cluster names in ``spark.checkpoint.dir``. A written table survives
the loss of executors, prunes columns and carries its row count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: What one task reads from a shuffle, and the pieces from which AQE builds such tasks. Rows with repeated keys shrink some
#: thirtyfold on their way through a shuffle, so 16 MB keep a task's sorts near half a GB.
TASK_BYTES, PIECES = "16m", 512


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: naive times are read as UTC, AQE splits skew, tasks are bounded by bytes."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    pieces = max(PIECES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(pieces))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, or one in the warehouse where that is unset.

    Both are shared by all executors. Tables written here go when the driver ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/wayfare-tables"


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own for a written table, removed at the end of the driver's JVM."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back, so later jobs do not recompute it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(table: DataFrame | None) -> None:
    """Delete a table that :func:`materialise` wrote, once nothing reads it any more."""
    path = getattr(table, "_written_at", None)
    if path is not None:
        spark = table.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        table._written_at = None


def materialise_counted(df: DataFrame, label: str = "table") -> tuple[DataFrame, int]:
    """As :func:`materialise`, with the row count (read from Parquet footers)."""
    table = materialise(df, label)
    return table, table.count()
