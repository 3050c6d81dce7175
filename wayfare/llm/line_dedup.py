"""Fuzzy line deduplication by MinHash; of each component of similar lines the first one stays.

A line is compared lower-cased, with its white space as single spaces. Lines of fewer than
``least_chars`` characters in that form are left alone: they are too short to call a repetition. The
bound is the length of a run, so that menu lines and scripts without spaces take part. Equal lines are one
*text line*, known by a 64-bit hash. A line's set is its distinct runs of eight characters (the line
itself if shorter). One hash of a run gives a bin and a value; the least value of each of 36 bins is
the signature, and an empty bin borrows from another by a fixed sequence. Nine bands of four bins find
a pair of similarity 0.8 with probability 0.991, of 0.9 with 0.9999. Pairs that share a band are
verified by the exact Jaccard similarity of their sets; components are found without pairs inside
them (see :mod:`linking`). The line at the smallest (doc_id, hash of the text, line number) of a component stays.

Null texts have no lines. A row is known by its id and a 64-bit hash of its text, so rows of one id
with different texts, and rows without an id, are judged each for itself. Rows equal in both count as
one document and stay or go alike. Null ids come before all others. An empty table gives an empty one; other columns are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import arrow, map_batches, small_batches, text_key
from .linking import link, parity_words, shared_only

RUN, BANDS, ROWS, LEAST_CHARS, SIMILARITY = 8, 9, 4, 8, 0.8
_BINS = BANDS * ROWS
_EMPTY = np.uint64(1 << 32)
_BASE = 0x9E3779B97F4A7C15
_PLACES = 1 << 26
#: Lines that are hashed at once: few enough that their arrays stay in the processor's cache.
_LINES_AT_ONCE = 256
#: Words of parity marks: runs of a long line would meet too often in fewer slots.
_MARK_WORDS = 16
_LINES = {"doc_id": pa.int64(), "text_key": pa.int64(), "n_filled": pa.int32(), "no": pa.list_(pa.int32()), "key": pa.list_(pa.int64()), "fresh": pa.list_(pa.int64()), "bands": pa.list_(pa.int64())}
_SEEN = 1 << 20
_TEXTS = {"key": pa.int64(), "line": pa.string(), "n": pa.int64(), "marks": pa.list_(pa.int64())}


def plain(line: str) -> str:
    return " ".join(line.lower().split())


def lines_of(text: str | None, least_chars: int = LEAST_CHARS) -> list[tuple[int, str]]:
    """Number and plain form of the lines that take part."""
    found = []
    for no, line in enumerate((text or "").lower().split("\n")):
        line = " ".join(line.split())
        if line and len(line) >= least_chars:
            found.append((no, line))
    return found


def line_key(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def run_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``RUN`` characters of all lines, and the line of each."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    h, power, reach = points.astype(np.uint64) + np.uint64(1), _BASE, 1
    while reach < RUN:  # h[i] becomes the hash of the run that starts at i
        h[:-reach] = h[:-reach] * np.uint64(power) + h[reach:]
        power, reach = power * power % (1 << 64), 2 * reach
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(lines)), sizes)
    whole = np.arange(len(points)) + RUN <= ends[owner]
    short = np.flatnonzero((sizes < RUN) & (sizes > 0))
    if len(short):
        begin = ends[short] - sizes[short]
        h[begin] = [xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass")) for i in short.tolist()]
        whole[begin] = True
    return h[whole], owner[whole]


def bands(lines: list[str]) -> np.ndarray:
    """The band keys of each line, one row per line."""
    least = np.full(len(lines) * _BINS, _EMPTY)
    for first in range(0, len(lines), _LINES_AT_ONCE):
        h, owner = run_hashes(lines[first:first + _LINES_AT_ONCE])
        high = h >> np.uint64(32)
        bin_ = high - high // np.uint64(_BINS) * np.uint64(_BINS)  # a quotient is faster than a remainder
        np.minimum.at(least, (owner + first) * _BINS + bin_.astype(np.int64), h & np.uint64(0xFFFFFFFF))
    least = least.reshape(len(lines), _BINS)
    own = least < _EMPTY
    made, have = least.copy(), own.copy()
    turn, open_rows = 0, np.flatnonzero(~own.all(axis=1))
    while len(open_rows) and turn < 8 * _BINS:
        turn += 1
        # The same bin asks the same bins in the same order, in every line.
        source = np.array([xxhash.xxh3_64_intdigest(bytes([b, turn % 256, turn // 256])) % _BINS for b in range(_BINS)])
        take = ~have[open_rows] & own[open_rows][:, source]
        at, bin_ = np.nonzero(take)
        made[open_rows[at], bin_] = least[open_rows[at], source[bin_]]
        have[open_rows[at], bin_] = True
        open_rows = open_rows[~have[open_rows].all(axis=1)]
    made = made.reshape(len(lines), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(lines), BANDS)).copy()
    for r in range(ROWS):
        key = (key ^ (key >> np.uint64(30))) * np.uint64(_BASE) + made[:, :, r]
    return ((key ^ (key >> np.uint64(28))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def describe(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per row of ``docs``: hash of its text, how many of its lines hold a word, numbers and keys of those that take part.

    ``fresh`` holds the keys that the task has not met before, ``bands`` their band keys; what a task has met is bounded, so a key may be fresh twice.
    """
    def make():
        seen: set[int] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            filled = [sum(not line.isspace() for line in (t or "").split("\n") if line) for t in texts]
            split = [lines_of(t, least_chars) for t in texts]
            keys = [[line_key(s) for _, s in part] for part in split]
            if len(seen) > _SEEN:
                seen.clear()
            fresh, new = [], []
            for part, known in zip(split, keys):
                mine = []
                for (_, line), key in zip(part, known):
                    if key not in seen:
                        seen.add(key)
                        mine.append(key)
                        new.append(line)
                fresh.append(mine)
            ends = pa.array(np.cumsum([0, *map(len, fresh)]) * BANDS, pa.int32())
            made = pa.ListArray.from_arrays(ends, pa.array(bands(new).ravel() if new else [], pa.int64()))
            return arrow(
                _LINES, batch.column(0), batch.column(2), filled, [[no for no, _ in part] for part in split], keys, fresh, made)

        return step

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key"))
    return map_batches(
        rows, make, "doc_id long, text_key long, n_filled int, no array<int>, key array<long>, fresh array<long>, bands array<long>")


def _line_texts(docs: DataFrame, keys: DataFrame, least_chars: int) -> DataFrame:
    """``key, line`` of the lines among ``keys`` and a few more.

    The keys travel to the scan as a Bloom filter of fixed size (8 MB), so no text is shuffled
    but the candidates'.
    """
    place = F.pmod("id", F.lit(_PLACES)) + 1  # Spark's bitmaps begin at 1
    rows = keys.select(place.alias("p")).groupBy((F.bitmap_bucket_number("p") - 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = bytearray(_PLACES // 8)
    for bucket, part in rows.collect():  # 8 MB at most; an iterator would run a job for each partition
        bits[bucket * 4096:bucket * 4096 + len(part)] = part
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def make():
        held = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[int, str] = {}
            for text in batch.column(0).to_pylist():
                for _, line in lines_of(text, least_chars):
                    key = line_key(line)
                    p = key % _PLACES
                    if held[p >> 3] >> (p & 7) & 1:
                        found[key] = line
            sets = _run_sets(list(found.values()))
            return arrow(_TEXTS, list(found), list(found.values()), [len(s) for s in sets], [parity_words(s, _MARK_WORDS) for s in sets])

        return step

    return map_batches(docs.select(F.col("text").cast("string")), make, "key long, line string, n long, marks array<long>").dropDuplicates(["key"])


def _run_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct run hashes of each line."""
    found = []
    for first in range(0, len(lines), _LINES_AT_ONCE):
        part = lines[first:first + _LINES_AT_ONCE]
        h, owner = run_hashes(part)
        bounds = np.searchsorted(owner, np.arange(len(part) + 1))
        found += [np.unique(h[a:b]) for a, b in zip(bounds, bounds[1:])]
    return found


#: Run hashes of the pairs that are compared at once.
_AT_ONCE = 1 << 20


def similar(left: list[str], right: list[str], similarity: float) -> np.ndarray:
    """Whether the run sets of each pair of lines reach the Jaccard similarity.

    Each line is cut once; the sets of many pairs are sorted together, and what stands twice in a pair is common.
    """
    place: dict[str, int] = {}
    sides = [np.array([place.setdefault(line, len(place)) for line in side], np.int64) for side in (left, right)]
    sets = _run_sets(list(place))
    sizes = np.array([len(s) for s in sets], np.int64)
    bounds = np.cumsum(sizes) - sizes
    runs = np.unique(np.concatenate(sets), return_inverse=True)[1]
    kinds = int(runs.max()) + 1
    total = sizes[sides[0]] + sizes[sides[1]]
    common = np.zeros(len(left), np.int64)
    cuts = np.searchsorted(np.cumsum(total), np.arange(_AT_ONCE, total.sum(), _AT_ONCE)) + 1
    for part in np.split(np.arange(len(left)), np.unique(cuts)):
        line, pair = np.concatenate([side[part] for side in sides]), np.concatenate([part, part])
        n = sizes[line]
        at = np.arange(n.sum()) + np.repeat(bounds[line] - (np.cumsum(n) - n), n)
        cells = np.sort(np.repeat(pair * kinds, n) + runs[at])
        common += np.bincount(cells[1:][cells[1:] == cells[:-1]] // kinds, minlength=len(left))
    return common >= similarity * (total - common) - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not batch.num_rows:
                return None
            keep = similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity)
            return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return step

    met = pairs.join(texts.select(F.col("key").alias("a"), F.col("line").alias("line_a")), "a")
    met = met.join(texts.select(F.col("key").alias("b"), F.col("line").alias("line_b")), "b")
    return map_batches(met.select("a", "b", "line_a", "line_b"), make, "a long, b long").distinct()


def kept_lines(docs: DataFrame, similarity: float = SIMILARITY, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """The described rows, and ``kept_id, kept_text, kept``: number and key of the lines of a row that stay."""
    small_batches(docs.sparkSession)
    whole = materialise(describe(docs, least_chars), "lines")
    signed = whole.select("fresh", F.posexplode("bands").alias("at", "sig"))
    rows = shared_only(signed.select("sig", F.get("fresh", F.expr(f"at div {BANDS}").cast("int")).alias("id")), pivots=True)
    described = materialise(whole.drop("fresh", "bands"), "lines")
    discard(whole)  # bands are not needed any more
    texts = materialise(_line_texts(docs, rows.select("id").distinct(), least_chars), "candidate-lines")
    marks = texts.select(F.col("key").alias("id"), "n", "marks")
    sized = rows.withColumns({c: F.lit(1 << 30) for c in ("room", "other_room")})  # a band says nothing of places
    sized._written_at = rows._written_at  # goes as soon as its successor is written
    linked = link(sized, marks, lambda pairs: _verified(pairs, texts, similarity), round(100 * similarity), words=_MARK_WORDS)
    discard(texts)
    spots = described.select("doc_id", "text_key", F.explode(F.arrays_zip("no", "key")).alias("l"))
    first = spots.groupBy(F.col("l.key").alias("id")).agg(F.min(F.struct("doc_id", "text_key", "l.no")).alias("spot"))
    first = first.join(linked.select("id", "component"), "id", "left")
    first = first.groupBy(F.coalesce("component", "id").alias("component")).agg(
        F.min(F.struct("spot.doc_id", "spot.text_key", "spot.no", F.col("id").alias("key"))).alias("spot"))
    kept = first.groupBy(F.col("spot.doc_id").alias("kept_id"), F.col("spot.text_key").alias("kept_text")).agg(
        F.collect_list(F.struct("spot.no", "spot.key")).alias("kept"))
    return described, kept


def _judged(docs: DataFrame, **rule) -> DataFrame:
    """The columns of :func:`line_report`, and ``text_key, n_filled``."""
    described, kept = kept_lines(docs, **rule)
    met = described.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_text")), "left")
    spots = F.arrays_zip("no", "key")
    gone = F.transform(F.array_except(spots, F.coalesce("kept", F.expr("cast(array() as array<struct<no:int,key:bigint>>)"))), lambda s: s["no"])
    return met.select(
        "doc_id", F.size("key").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"),
        F.sort_array(gone).alias("removed"), "text_key", "n_filled")


def line_report(docs: DataFrame, **rule) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed``: the lines of each document that take part, and those that go."""
    return _judged(docs, **rule).drop("text_key", "n_filled")


def dedup_lines(docs: DataFrame, **rule) -> DataFrame:
    """``docs`` without the lines that go; documents all of whose lines with a word went are left out.

    Lines too short to take part stay, also where no other line of their document does. Documents
    without lines that take part are as they were.
    """
    removed = _judged(docs, **rule).where("n_removed > 0").dropDuplicates(["doc_id", "text_key"])
    removed = removed.select(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text"), "removed", F.expr("n_removed = n_filled").alias("empty"))
    names = [c for c in docs.columns if c != "text"]
    # Other columns travel as one struct, so that no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (text_key(F.col("text")) == F.col("gone_text"))
    met = rows.join(removed, same, "left")
    lines = F.split(F.col("text"), "\n")

    def without(gone):
        return F.filter(lines, lambda line, i: ~F.array_contains(gone, i))

    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(without(F.col("removed")), "\n"))
    met = met.where(~F.coalesce("empty", F.lit(False)))
    return met.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
