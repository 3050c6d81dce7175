"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words of smallest period ``q`` that no neighbour extends and that
is at least ``max(least, copies * q)`` words long, ``copies`` being 3. Every run holds one rightmost
square of its period, and that square branches: its halves start at two suffixes ``i`` and ``i + q``
whose longest common prefix is ``q`` exactly. They lie in two children of one LCP interval of depth
``q``. So for each LCP interval (as binary splits of the suffix array, no tree nodes) the suffixes of
its smaller child look up ``ISA[i + depth]`` and ``ISA[i - depth]`` in the other child: O(n log n)
look-ups. Each square found is rotated to the left as long as it stays a square, which gives the run;
runs of one extent are one run of the smallest period.

All steps are numpy over the words of many texts at once. Words that stand fewer than ``copies`` times
in their stretch cannot be part of a run, so they cut texts into stretches first, and again until
nothing changes; stretches shorter than ``least`` hold no run. Each stretch has an alphabet of its
own, so no match leaves it. The ranks of the prefix doubling are kept by level (4 bytes a word and level):
they answer whether two substrings are equal, which is what rotating asks.

A null, empty or wordless text has no runs and keeps nothing. Very long texts form a block of their own:
memory grows with the longest text, not with the batch. Repeated rows are each judged; rows without
an id are never altered by :func:`planted`. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, map_batches, small_batches

LEAST, COPIES = 24, 3
_BLOCK = 400_000


class _Numbers(dict):
    """Word -> number, in order of appearance."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _equal_parts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, LCP array (``lcp[k]`` between entries ``k - 1`` and ``k``) and ranks by level.

    ``ranks[l][i]`` numbers the substring of ``2 ** l`` letters at ``i``. Ends of stretches are letters of
    their own, so a substring that runs past an end equals no other.
    """
    n = len(a)
    rank = np.unique(a, return_inverse=True)[1].astype(np.int32)
    ranks, reach = [rank], 1
    while int(rank.max()) < n - 1:
        second = np.full(n, -1, np.int64)
        second[:n - reach] = rank[reach:] if reach < n else second[:0]
        key = rank.astype(np.int64) * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        reach *= 2
        ranks.append(rank)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    x, y = suffixes[:-1].copy(), suffixes[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((x < n) & (y < n))
        same = inside[ranks[level][x[inside]] == ranks[level][y[inside]]]
        x[same] += 1 << level
        y[same] += 1 << level
    lcp[1:] = x - suffixes[:-1]
    return suffixes, lcp, ranks


def _splits(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each ``k`` with ``lcp[k] > 0``: the first entry of its left part and the last of its right part.

    The left part reaches to the last smaller value, the right part to the next smaller or equal one, so
    two entries meet in exactly one split, that of the least value between them.
    """
    values, n = lcp.tolist(), len(lcp)
    first, last, stack = [0] * n, [n - 1] * n, []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] >= v:
            last[stack.pop()] = k - 1
        first[k] = stack[-1] if stack else 0
        stack.append(k)
    k = np.flatnonzero(lcp > 0)
    return k, np.array(first)[k], np.array(last)[k]


def _looked_up(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the ranges, and the range of each."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner], owner


def branching_squares(a: np.ndarray, suffixes, lcp) -> tuple[np.ndarray, np.ndarray]:
    """``start, period`` of all squares whose halves' common prefix is one half exactly."""
    n = len(a)
    isa = np.empty(n, np.int64)
    isa[suffixes] = np.arange(n)
    k, first, last = _splits(lcp)
    left, right = k - first, last - k + 1
    small_left = left <= right
    entry, owner = _looked_up(np.where(small_left, first, k), np.where(small_left, left, right))
    other_first = np.where(small_left, k, first)[owner]
    other_last = np.where(small_left, last, k - 1)[owner]
    depth, i = lcp[k][owner], suffixes[entry]
    found = []
    for at, start in ((i + depth, i), (i - depth, i - depth)):
        fits = np.flatnonzero((at >= 0) & (at < n))
        place = isa[at[fits]]
        hit = fits[(place >= other_first[fits]) & (place <= other_last[fits])]
        found.append((start[hit], depth[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _rotated(start: np.ndarray, period: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How often each square can move left by one word and stay a square."""
    at = start.copy()
    for level in range(len(ranks) - 1, -1, -1):
        step, again = 1 << level, True
        while again:  # the top level may fit more than once
            can = np.flatnonzero(at >= step)
            same = can[ranks[level][at[can] - step] == ranks[level][at[can] - step + period[can]]]
            at[same] -= step
            again = level == len(ranks) - 1 and len(same) > 0
    return start - at


def _stretches(words: np.ndarray, owner: np.ndarray, least: int, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may lie in a run, and the stretch of each."""
    place = np.arange(len(words))
    part = owner.astype(np.int64)
    while len(place):
        key = np.unique(part * (int(words.max()) + 1) + words[place], return_inverse=True)[1]
        often = np.bincount(key)[key] >= copies
        place, part = place[often], part[often]
        if not len(place):
            break
        new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(part) != 0)])
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= least
        if often.all() and long.all():
            break
        place, part = place[long], part[long]
    return place, part


def find_runs(words: np.ndarray, owner: np.ndarray, least: int = LEAST, copies: int = COPIES) -> np.ndarray:
    """Rows ``start, length, period`` (places in ``words``) of all runs, by start, then period.

    ``owner`` names the text of each word, in ascending order; no run leaves its text.
    """
    none = np.empty((0, 3), np.int64)
    place, part = _stretches(words, owner, least, copies)
    if not len(place):
        return none
    ends = np.flatnonzero(np.concatenate([np.diff(part) != 0, [True]]))
    letters = part * (int(words.max()) + 1) + words[place]
    letters = np.insert(letters, ends + 1, -1 - np.arange(len(ends)))
    origin = np.insert(place, ends + 1, -1)
    suffixes, lcp, ranks = _equal_parts(letters)
    start, period = branching_squares(letters, suffixes, lcp)
    if not len(start):
        return none
    left = _rotated(start, period, ranks)
    length = left + 2 * period
    whole = length >= np.maximum(least, copies * period)
    start, length, period = (start - left)[whole], length[whole], period[whole]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    once = np.ones(len(start), bool)  # of one extent the smallest period
    once[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    found = np.column_stack([origin[start], length, period])[once]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def planted(doc_id: int | None, words: list) -> list:
    """The words with a repetition planted in a tenth of the documents, as their id's hash says."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * ((n - a) // p + 1))[:n - a]


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words without those that some run repeats: of each run its first period stays."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
    return [words[i] for i in kept]


_TYPES = {"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(),
          "exponent_milli": pa.int64(), "runs": pa.list_(pa.list_(pa.int64())), "collapsed": pa.string()}
_DIGESTS = {k: t for k, t in _TYPES.items() if k not in ("runs", "collapsed")} | {
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def _longest(runs: np.ndarray) -> tuple:
    """Start, length, period and 1000 x exponent of the run of the greatest exponent."""
    best = None
    for s, n, q in runs.tolist():
        if best is None or n * best[2] > best[1] * q:  # rows come by start, then period
            best = (s, n, q)
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])


def _judged(batch: pa.RecordBatch, plant: bool, least: int, copies: int):
    """``(doc_id, words, runs)`` of each row, many texts to a block."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    numbers, flat, sizes, held = _Numbers(), array("q"), [], []

    def judge():
        words = np.frombuffer(flat, np.int64) if len(flat) else np.empty(0, np.int64)
        runs = find_runs(words, np.repeat(np.arange(len(sizes)), sizes), least, copies) if len(words) else np.empty((0, 3), np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        cut = np.searchsorted(runs[:, 0], bounds)
        for k, (doc_id, split) in enumerate(held):
            yield doc_id, split, runs[cut[k]:cut[k + 1]] - np.array([bounds[k], 0, 0])

    for doc_id, text in zip(ids, texts):
        split = (text or "").encode().split()
        if plant:
            split = planted(doc_id, split)
        flat.extend(map(numbers.__getitem__, split))
        sizes.append(len(split))
        held.append((doc_id, split))
        if len(flat) > _BLOCK:
            yield from judge()
            numbers, flat, sizes, held = _Numbers(), array("q"), [], []
    yield from judge()


def _run(docs: DataFrame, digests: bool, plant: bool, least: int, copies: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, words, runs in _judged(batch, plant, least, copies):
                kept = b" ".join(collapsed(words, runs))
                if digests:
                    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                    last = (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                else:
                    last = (runs.tolist(), kept.decode())
                rows.append((doc_id, len(runs), *_longest(runs), *last))
            types = _DIGESTS if digests else _TYPES
            return arrow(types, *(zip(*rows) if rows else [[]] * len(types)))

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ends = "runs_sha256 string, collapsed_sha256 string" if digests else "runs array<array<bigint>>, collapsed string"
    return map_batches(
        rows, make, f"doc_id long, n_runs long, start long, length long, period long, exponent_milli long, {ends}")


def repeated_runs(docs: DataFrame, *, plant: bool = False, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """``doc_id, n_runs``, the run of the greatest exponent, all ``runs`` and the ``collapsed`` text of each row."""
    return _run(docs, False, plant, least, copies)


def run_digests(docs: DataFrame, *, plant: bool = True, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """The same with SHA-256 digests in place of the runs and the text."""
    return _run(docs, True, plant, least, copies)
