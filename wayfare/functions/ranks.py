"""Ranks, running totals and order statistics without a single-task sort.

Three devices keep the work spread, whatever the key distribution:

* value histograms first (``groupBy(value).count()`` combines map-side), so
  ties cost nothing;
* hash order: MD5 text is uniform, so its first three digits cut any group,
  however large, into 4096 even slots whose offsets are a tiny running sum;
* value order: quantile bounds cut the values into chunks, as many as the row
  count asks for, and only the chunk totals are scanned in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise, materialise_counted

#: Rows that one ordered window holds on average; their number gives the number of chunks.
ROWS_PER_CHUNK = 1_000_000
#: Bounds that are compared with every value; from there on they are searched.
FEW_BOUNDS = 32
_SLOT_DIGITS = 3


def keyed_hash(column: str | Column, seed: int | str) -> Column:
    """Deterministic uniform text for a key; ordering by it is a seeded shuffle."""
    column = F.col(column) if isinstance(column, str) else column
    return F.md5(F.concat(column.cast("string"), F.lit(f"|{seed}")))


def _slot(h: str) -> Column:
    return F.substring(F.col(h), 1, _SLOT_DIGITS)


def _before(groups: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def hash_rank(
    df: DataFrame, key: str, seed: int | str, groups: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """1-based position of each row in seeded hash order within its group."""
    groups = list(groups)
    tagged = df.withColumn("_h", keyed_hash(key, seed)).withColumn("_slot", _slot("_h"))
    sizes = tagged.groupBy(*groups, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *groups, "_slot",
        F.coalesce(F.sum("_n").over(_before(groups, [F.col("_slot")])), F.lit(0)).alias("_skip"),
    )
    within = Window.partitionBy(*groups, "_slot").orderBy("_h", key)
    return (
        tagged.withColumn("_r", F.row_number().over(within))
        .join(offsets.hint("merge"), [*groups, "_slot"])  # the window's order serves the join too
        .withColumn(name, F.col("_r") + F.col("_skip"))
        .drop("_h", "_slot", "_r", "_skip")
    )


def hash_cut(
    df: DataFrame, key: str, seed: int | str, size: Callable[[Column], Column],
    groups: Sequence[str] = (), name: str = "cut",
) -> DataFrame:
    """Per group, the hash of the k-th key in hash order, with ``k = size(n)``.

    Keys must be unique within a group. A row belongs to the first ``k`` exactly
    when ``keyed_hash(key, seed) <= cut``, so selecting a sample is a filter and
    needs neither a global sort nor a join on the key. Groups with ``k < 1``
    have no row.
    """
    groups = list(groups)
    tagged = df.select(*groups, keyed_hash(key, seed).alias("_h")).withColumn("_slot", _slot("_h"))
    sizes = tagged.groupBy(*groups, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    ordered = sizes.select(
        "*",
        F.coalesce(F.sum("_n").over(_before(groups, [F.col("_slot")])), F.lit(0)).alias("_skip"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("_total"),
    ).withColumn("_k", size(F.col("_total")))
    # one slot per group: at most as many rows as there are groups
    chosen = ordered.where((F.col("_skip") < F.col("_k")) & (F.col("_k") <= F.col("_skip") + F.col("_n")))
    within = Window.partitionBy(*groups, "_slot").orderBy("_h")
    return (
        tagged.join(chosen.drop("_n", "_total"), [*groups, "_slot"])
        .withColumn("_r", F.row_number().over(within))
        .where(F.col("_r") + F.col("_skip") == F.col("_k"))
        .select(*groups, F.col("_h").alias(name))
    )


def value_chunk(value: Column, bounds: Sequence[float]) -> Column:
    """Chunk number of a value: odd when it equals a bound, even when between two.

    A value that holds a large share of rows is a bound, hence alone in its chunk. Few bounds are compared one by one;
    the number of bounds grows with the rows, so many are searched by halves.
    """
    if len(bounds) > FEW_BOUNDS:
        known = np.sort(np.array(bounds, float))

        @F.pandas_udf("int")
        def search(values: pd.Series) -> pd.Series:
            v = values.to_numpy(float)
            return pd.Series(np.searchsorted(known, v, "left") + np.searchsorted(known, v, "right")).astype("int32")

        return F.when(value.isNull(), F.lit(0)).otherwise(search(value.cast("double")))
    array = F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>")
    return (
        F.size(F.filter(array, lambda b: b < value)) + F.size(F.filter(array, lambda b: b <= value))
    )


def chunk_bounds(df: DataFrame, column: str, chunks: int) -> list[float]:
    """Approximate quantiles that cut a column into ``chunks``; read once, used as literals."""
    if chunks < 2:
        return []
    probabilities = [i / chunks for i in range(1, chunks)]
    found = df.select(F.col(column).cast("double").alias("v")).approxQuantile(
        "v", probabilities, 0.25 / chunks
    )
    return sorted(set(found))


def value_positions(
    df: DataFrame, value: str, key: str, seed: int | str, rows: int, name: str = "pos", *,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """0-based position of each of ``rows`` rows by value, ties by hash of the key, then key.

    A value with many ties is a chunk of its own and is cut further by the hash,
    so the order does not depend on the chunks.
    """
    bounds = chunk_bounds(df, value, -(-rows // rows_per_chunk))
    tagged = df.withColumns({"_h": keyed_hash(key, seed), "_chunk": value_chunk(F.col(value), bounds)})
    tagged = tagged.withColumn("_sub", F.when(F.col("_chunk") % 2 == 1, _slot("_h")).otherwise(""))
    cells = tagged.groupBy("_chunk", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_chunk", "_sub").rowsBetween(Window.unboundedPreceding, -1)  # one row per cell
    cells = cells.select("_chunk", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    within = Window.partitionBy("_chunk", "_sub").orderBy(value, "_h", key)
    numbered = tagged.withColumn("_r", F.row_number().over(within) - 1).join(cells, ["_chunk", "_sub"])
    return numbered.withColumn(name, F.col("_r") + F.col("_skip")).drop("_h", "_chunk", "_sub", "_r", "_skip")


def running_totals(
    table: DataFrame, order: str, sums: Sequence[str], groups: Sequence[str] = (), *,
    descending: bool = False, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``<s>_cum`` for each sum column, in value order within each group.

    ``table`` holds one row per (group, value). It is written once; its row
    count gives the number of chunks.
    """
    groups = list(groups)
    table, rows = materialise_counted(table, "totals")
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())

    bounds = chunk_bounds(table, order, -(-rows // rows_per_chunk))
    tagged = table.withColumn("_chunk", value_chunk(F.col(order).cast("double"), bounds))
    totals = tagged.groupBy(*groups, "_chunk").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = _before(groups, [direction("_chunk")])
    offsets = totals.select(
        *groups, "_chunk",
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
    )
    upto = (
        Window.partitionBy(*groups, "_chunk").orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tagged.select("*", *[F.sum(s).over(upto).alias(f"_i_{s}") for s in sums])
        .join(offsets, [*groups, "_chunk"])
        .select(
            *table.columns,
            *[(F.col(f"_i_{s}") + F.col(f"_o_{s}")).alias(f"{s}_cum") for s in sums],
        )
    )


def mid_ranks(
    df: DataFrame, ranks: dict[str, str], groups: Sequence[str] = (), *, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add, for each ``value: name`` of ``ranks``, the 1-based rank within the group; ties share their mean rank.

    Ranks come from running totals over the value histogram, so no task sorts a whole group. They go back to the
    rows by value; values of more than ``rows_per_chunk`` rows, of which there are at most rows / ``rows_per_chunk``,
    are broadcast, so that no such value is one task's join. Null values rank first; rows with a null group have no rank
    and are left out. ``df`` is read several times and should be a written table.
    """
    groups, out, few = list(groups), df, df.count() <= rows_per_chunk
    keys = [f"_k{i}" for i in range(len(groups))]
    for value, name in ranks.items():
        counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
        totals = running_totals(counts, value, ["_n"], groups, rows_per_chunk=rows_per_chunk)
        found = totals.select(
            *[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).alias("_kv"),
            (F.col("_n_cum") - (F.col("_n") - 1) / 2).alias(name), "_n")
        same = F.col(value).eqNullSafe(F.col("_kv"))
        for g, k in zip(groups, keys):
            same = same & (F.col(g) == F.col(k))
        kept = [*out.columns, name]
        if few:  # no value can have more rows than a chunk
            out = out.join(found, same).select(*kept)
        else:
            found = materialise(found, "ranks")
            common = F.broadcast(found.where(F.col("_n") > rows_per_chunk))
            rare = out.join(common, same, "left_anti").join(found.where(F.col("_n") <= rows_per_chunk), same)
            out = out.join(common, same).select(*kept).unionByName(rare.select(*kept))
    return out


def nearest_quantiles(
    df: DataFrame, columns: Sequence[str], q: float, groups: Sequence[str] = (), width: int = 4096
) -> DataFrame:
    """Per group and integer column, the value at rank ``round((n - 1) * q)``.

    Half ranks round up. Returns (groups, ``column``, ``value``). All columns
    share one value histogram. It is cut into blocks of ``width`` consecutive
    values; the block holding the rank is found from block counts, then the
    value inside it, so no task sees more than a block table or one block.
    """
    keys = [*groups, "column"]
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("_v")) for c in columns])
    counts = (
        df.select(*groups, F.explode(cells).alias("c")).select(*groups, "c.*")
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_block", F.floor(F.col("_v") / width))
    )
    located = (
        counts.groupBy(*keys, "_block").agg(F.sum("_n").alias("_n"))
        .select(
            *keys, "_block", "_n",
            F.coalesce(F.sum("_n").over(_before(keys, [F.col("_block")])), F.lit(0)).alias("_skip"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
        )
        .withColumn("_rank", F.floor((F.col("_total") - 1) * F.lit(q) + F.lit(0.5)))
        .where((F.col("_skip") <= F.col("_rank")) & (F.col("_rank") < F.col("_skip") + F.col("_n")))
        .select(*keys, "_block", "_skip", "_rank")
    )
    inside = counts.join(F.broadcast(located), [*keys, "_block"])  # one row per group and column
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        inside.select(*keys, "_v", "_rank", (F.col("_skip") + F.sum("_n").over(upto)).alias("_upto"))
        .where(F.col("_upto") > F.col("_rank"))
        .groupBy(*keys).agg(F.min("_v").alias("value"))
    )


def nearest_quantile(df: DataFrame, column: str, q: float, name: str, width: int = 4096) -> DataFrame:
    """One row with the quantile of one column, see :func:`nearest_quantiles`."""
    return nearest_quantiles(df, [column], q, width=width).select(F.col("value").alias(name))
