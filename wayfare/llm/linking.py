"""Linking by shared signatures without pairs inside a group that is already one component.

Input are rows ``sig, id``: two items that must link share a signature. A signature's items are first
compared with one of them only, its pivot; what links becomes components, and the next round picks
another pivot and compares just the items of other components with it. A pivot has met all others of its
signature, so it leaves it after its round, and a signature of two items is done after the first. A group of
copies thus costs a few comparisons per member. In the end all pairs of items that share a signature but not a component
are compared, so no link between components is lost; the rounds before make these few.

The number of rounds only decides which comparisons are spared, never the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialise
from .common import members, star_steps

#: 64-bit words of a set's parity marks, where the caller names no other number (a power of two).
MARK_WORDS = 8


#: Star steps between two rounds: labels that are not final only leave more to compare.
_STEPS = 1


def shared_only(signatures: DataFrame, pivots: bool = False) -> DataFrame:
    """The rows ``sig, id`` whose signature two ids or more have, written. One shuffle, by signature.

    ``pivots`` adds the smallest row of the signature as ``pivot`` (null in rows of its id) and, where rows have a ``room``, its
    ``other_room``; ``later`` is true in rows of signatures that hold two ids or more beside that row, except in that row.
    """
    whole = Window.partitionBy("sig")
    met = signatures.withColumns({"_lo": F.min("id").over(whole), "_hi": F.max("id").over(whole)}).where("_lo <> _hi")
    if pivots:
        own = F.struct("id", *[c for c in signatures.columns if c not in ("sig", "id")])
        met = met.withColumn("_p", F.min(own).over(whole))
        rest = F.when(own != F.col("_p"), F.col("id"))
        met = met.withColumn("later", rest.isNotNull() & (F.min(rest).over(whole) < F.max(rest).over(whole)))
        met = met.withColumn("pivot", F.expr("if(_p.id = id, null, _p.id)"))
        met = met.withColumn("other_room", F.col("_p.room")) if "room" in signatures.columns else met
        met = met.drop("_p")
    return materialise(met.drop("_lo", "_hi").distinct(), "shared-signatures")


def _open_rows(rows: DataFrame, stars: DataFrame | None, turn: int) -> tuple[DataFrame, int, float]:
    """Rows of signatures that still hold more than one component, written; their number, and that of pairs between components.

    ``comp`` is a row's component as far as it is known, ``pivot`` a row of the signature picked by hash (null in rows of its
    component). Rows that are not ``later`` are done and left out; the row that is the pivot is not ``later``. One shuffle by id and
    one by signature.
    """
    if "later" in rows.columns:
        rows = rows.where("later")
    known = rows.select("sig", "id", "room", F.col("id").alias("comp"))
    if stars is not None:
        labels = stars.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        known = known.drop("comp").join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    whole = Window.partitionBy("sig")
    key = F.struct(F.xxhash64("id", F.lit(turn)), "id", "comp", "room")
    held = known.withColumns({"n": F.count(F.lit(1)).over(whole), "p": F.min(key).over(whole)})
    held = held.withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("sig", "comp"))).where("own < n")
    seen = Observation()
    held = held.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.expr("cast(n - own as double) / 2")).alias("pairs"))
    held = materialise(held.select(
        "sig", "id", "comp", "room", F.expr("if(p.comp = comp, null, p.id)").alias("pivot"), F.col("p.room").alias("other_room"),
        F.expr("not (p.id = id and p.room = room)").alias("later")), "open-signatures")
    found = seen.get
    return held, found["rows"] or 0, found["pairs"] or 0.0


def parity_words(tokens: np.ndarray, words: int = MARK_WORDS) -> np.ndarray:
    """Parity of the number of tokens of each of ``64 * words`` slots, packed."""
    parity = np.bincount((tokens & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def may_link(percent: int, words: int = MARK_WORDS) -> str:
    """What sizes, places and parities allow, between a row and ``other_*``, cheapest first.

    Two sets of ``n`` and ``other_n`` tokens need ``common = percent * (n + other_n) / (100 + percent)`` common ones. ``room`` bounds
    the common tokens of a pair that shares this signature. Slots of different parity are differing tokens.
    """
    differing = " + ".join(f"bit_count(marks[{k}] ^ other_marks[{k}])" for k in range(words))
    return (f"100 * least(n, other_n) >= {percent} * greatest(n, other_n)"
            f" and {100 + percent} * cast(least(room, other_room) as bigint) >= {percent} * (n + other_n)"
            f" and {differing} <= n + other_n - 2 * ceil({percent} * (n + other_n) / {100 + percent})")


def _likely(pairs: DataFrame, marks: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs ``a, b`` of ``a, b, room`` that :func:`may_link` does not rule out."""
    met = pairs.join(marks.select(F.col("id").alias("a"), "n", "marks"), "a")
    met = met.join(marks.select(F.col("id").alias("b"), F.col("n").alias("other_n"), F.col("marks").alias("other_marks")), "b")
    return met.withColumn("other_room", F.col("room")).where(may_link(percent, words)).select("a", "b")


def link(rows: DataFrame, marks: DataFrame, verify, percent: int, rounds: int = 3, spare: int = 4, words: int = MARK_WORDS) -> DataFrame:
    """``id, component, n_links`` of all ids that link to another.

    ``rows``: ``sig, id, room, pivot, other_room, later`` as of :func:`shared_only`; ``marks``: ``id, n, marks`` of each id, its number of tokens and
    their :func:`parity_words` (``words`` of them). Pivots meet at most one row each, so their pairs get marks afterwards; the rows of the last round
    hold them, so that pairs that :func:`may_link` rules out do not leave the join. ``verify(pairs)`` gets distinct pairs
    ``a < b`` and returns those that link. ``rows`` is deleted. Rounds of pivots end after ``rounds``, or as soon as all pairs
    between components that have not met are at most ``spare`` for each of ``rows``; then those pairs are compared, which is
    the last round. ``n_links`` counts the links that were needed and found. A table goes when its successor is written.
    """
    spark, links, stars, final, most = rows.sparkSession, None, None, False, spare * rows.count()
    for turn in range(rounds + 1):
        last = turn == rounds
        if turn:
            before, (rows, _, left) = rows, _open_rows(rows, stars, turn)
            discard(before)
            if not left:
                break
            last = last or left <= most
        if not last:
            pairs = rows.where("pivot is not null").groupBy(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
            pairs = _likely(pairs.agg(F.max(F.least("room", "other_room")).alias("room")), marks, percent, words)
        else:
            if not turn:
                rows = rows.withColumn("comp", F.col("id"))
            sized = rows.join(marks, "id").select("sig", "id", "comp", "n", "room", "marks")
            # The same columns in the same order, so that both sides share one shuffle.
            met = sized.toDF("sig", "a", "comp", "n", "room", "marks").join(
                sized.toDF("sig", "b", "other_comp", "other_n", "other_room", "other_marks"), "sig")
            pairs = met.where("a < b and comp <> other_comp").where(may_link(percent, words)).select("a", "b").distinct()
        found = materialise(verify(pairs), "needed-links")
        if found.head(1):
            links = found if links is None else links.unionByName(found)
            edges = found.select(F.col("b").alias("u"), F.col("a").alias("v"))
            before = stars
            stars = star_steps(edges if stars is None else stars.unionByName(edges), None if last else _STEPS)
            final = last
            discard(before)
        if last:
            break
    discard(rows)
    if stars is None:
        return spark.createDataFrame([], rows.select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links")).schema)
    if not final:
        before, stars = stars, star_steps(stars)
        discard(before)
    # Labels between rounds are not final, so a pair may have been compared twice.
    ends = links.distinct().select(F.explode(F.array("a", "b")).alias("id"))
    return members(stars).join(ends.groupBy("id").agg(F.count("*").alias("n_links")), "id", "left")


def membership_bits(ids: DataFrame, size: int = 1 << 26):
    """A Bloom filter of fixed size over a column ``id`` (long): 8 MB, whatever the number of ids."""
    place = F.pmod(F.xxhash64("id"), F.lit(size))
    rows = ids.select(place.alias("p")).groupBy((F.bitmap_bucket_number("p")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    return rows.withColumn("bucket", F.col("bucket") - 1)
