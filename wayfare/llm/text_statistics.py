"""Statistics of a text as Spark columns: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import WORD, let

_SPACE = r"[ \x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def shingles_of(words: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, in order."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - size),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, runs).otherwise(F.expr("cast(array() as array<bigint>)"))


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a run of ``size`` words found at least twice in the text.

    Runs are compared by their 64-bit hash. Sorting (hash, place) brings equal runs together; the
    places of such runs, in order, cover ``min(size, distance to the next)`` words each.
    """
    def covered(places):
        last = F.size(places) - 1
        gaps = F.transform(places, lambda p, i: F.when(
            i < last, F.least(F.lit(size), F.get(places, i + 1) - p)).otherwise(size))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def among(runs):
        ordered = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s):
            twin = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        counted = let(let(ordered, places), covered)
        return F.when(F.size(F.array_distinct(runs)) < F.size(runs), counted).otherwise(F.lit(0).cast("long"))

    return let(shingles_of(words, size), among)


def count_of(text: Column, characters: str) -> Column:
    """Characters of the regex class body ``characters`` in ``text``."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def line_numbers(text: Column) -> Column:
    """Struct of lines with a word and of those equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    return let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def base_statistics(text: Column) -> Column:
    """Struct ``n_words, word_chars, n_repeat_words, n_distinct_words`` of the words of ``text``."""
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        repeated_words(w).alias("n_repeat_words")))


def word_statistics(text: Column) -> Column:
    """As :func:`base_statistics` without the repeated runs."""
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words")))
