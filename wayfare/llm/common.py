"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from functools import reduce
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialise

#: ASCII upper case to lower case, every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^ \x09-\x0D]+"

#: Rows and bytes of one Arrow batch: long texts must not meet thousands to a batch.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return table(spark, folder, "documents")


def map_batches(df: DataFrame, make, schema: str) -> DataFrame:
    """``mapInArrow`` over ``make()``'s function from one batch to one batch (or None).

    ``make`` runs once per task, so that models load there and caches live as long as it. What other tasks left in the
    worker and ``make`` does not ask for goes first.
    """
    def run(batches):
        step = only_asked(make)
        for batch in batches:
            out = step(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def per_worker(key: str, make):
    """``make()``, once per Python worker: the value outlives a task, for later tasks to reuse."""
    kept, asked = _kept()
    asked.add(key)
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _kept() -> tuple[dict, set]:
    """The values of :func:`per_worker`, and the keys the task has asked for.

    Functions travel to workers by value, so the place is a module that exists in the worker only.
    """
    place = sys.modules.setdefault("wayfare_worker", ModuleType("wayfare_worker")).__dict__
    return place.setdefault("kept", {}), place.setdefault("asked", set())


def only_asked(make):
    """``make()``, after which the worker keeps only the values that it asked for: one operator's tables do not stay
    beside the next one's."""
    kept, asked = _kept()
    asked.clear()
    made = make()
    for key in set(kept) - asked:
        del kept[key]
    pa.default_memory_pool().release_unused()
    return made


def arrow(types: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types.values())],
        names=list(types),
    )


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents whose labels are never learnt from (null id: false)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_key(text: Column) -> Column:
    """64-bit hash of a text: with the id it tells rows apart where ids repeat or are null."""
    return F.xxhash64(text.cast("string"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def star_steps(links: DataFrame, steps: int | None = None) -> DataFrame:
    """``links`` (``u > v``) after large-star and small-star steps, written: so many, or until nothing changes.

    Each step hangs neighbours on their smallest neighbour: an aggregate with partial minima and one join for the larger ones,
    so a hub costs no more than its own edges, and a window for the smaller ones. An edge becomes one edge, so the table
    never grows, and what belongs together stays connected after any number of steps. A step that moves no edge has found
    stars: each node hangs on the smallest of its component. The tables between are deleted.
    """
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v"), F.expr("m < u").alias("moved"))
        hung = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        seen = Observation()
        small = hung.select(F.expr("if(v = m, u, v)").alias("u"), F.col("m").alias("v"), F.expr("moved or v <> m").alias("moved"))
        links = materialise(small.observe(seen, F.count_if("moved").alias("moved")).drop("moved"), "links")
        discard(before)
        before = links
        steps = None if steps is None else steps - 1
        if steps == 0 or not seen.get["moved"]:
            return links


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps (:func:`star_steps`).

    ``edges`` holds pairs of comparable ids. Returns ``id, component`` (the smallest id of the
    component) for every id that has an edge to another.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = materialise(links, "links")
    stars = star_steps(links)
    discard(links)
    return members(stars)


def members(stars: DataFrame) -> DataFrame:
    """``id, component`` of the nodes of finished stars."""
    return stars.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
