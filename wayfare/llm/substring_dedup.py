"""Removal of word passages that stand in an earlier document, by suffix automata of reference shards.

A *window* is ``WINDOW`` (50) consecutive words. A window is removed if its words also start a window in a
document with a smaller id. A suffix automaton of reference passages gives, for each word of a document
that streams past, the longest match that ends there (matching statistics); a match of ``WINDOW`` words or more
is a window to remove.

No automaton of the corpus can be broadcast, so the references are sharded and only passages that can match
meet a shard:

1. *Anchors.* Each window has one anchor, the least hash among its 30-word shingles (leftmost of equals), which
   depends on the window's words alone. Equal windows have equal anchors. One row per anchor holds
   the windows it stands for.
2. *Holders.* Rows are dealt by ranges of (anchor, document) and read in order (:func:`holders`). The smallest
   document of an anchor is its reference, later ones are probes; anchors of one document end here.
   An anchor that very many documents share is spread over tasks; tasks tell each other only the first and last
   anchor they saw.
3. *Shards.* A reference document is cut into shards of ``BLOCK`` words. Passages of references and probes meet by
   shard. The shard goes to each task that streams its documents: a shard with very many probes is
   copied to as many tasks as they need (the list of such shards has at most 2^20 rows, which is what is
   broadcast). A task builds the automaton of a shard and streams the probes through it.
4. *The rest.* A probe's window that is not in the reference may still be in another document between the two.
   Such windows meet once more by a hash of all their words, by :func:`holders` again.
5. *Removal.* Texts that lose words are picked by a bitmap sized by their number and joined with their ranges;
   all other texts are only read.

Windows are judged on the input. Rows that share an id do not remove each other's words; each row is judged
by its id and a 64-bit hash of its text. Rows without an id have no place in the order: they lose nothing
and remove nothing. Null, empty and short texts have no windows. Equal rows fare alike. A very long text
is read whole; memory grows with the longest text. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import arrow, map_batches, small_batches, text_key

WINDOW, SHINGLE, BLOCK = 50, 30, 4096
_REACH = WINDOW - SHINGLE + 1  # shingles of a window
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9
_PLACE_BITS = 28
#: Probes of a shard that one task streams at least before the shard is copied.
_HOT = 512


# anchors ---------------------------------------------------------------------------------
def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``SHINGLE`` words from each place on, from the words' hashes."""
    n = len(hashes) - SHINGLE + 1
    power = np.full(len(hashes), _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
    h = (total[SHINGLE:] - total[:-SHINGLE]) * np.cumprod(back)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, anchor, start, n``: the anchors of each text and the run of windows each stands for."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(sizes.sum())
    if total < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none, none
    h = shingle_hashes(np.fromiter((xxhash.xxh3_64_intdigest(w) for words in texts for w in words), np.uint64, total))
    place = np.arange(len(h), dtype=np.uint64)
    least = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | place
    reach = 1
    while 2 * reach <= _REACH:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if _REACH > reach:
        least = np.minimum(least[:reach - _REACH], least[_REACH - reach:])
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[:len(least)]
    window = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[text])
    if not len(window):
        none = np.empty(0, np.int64)
        return none, none, none, none
    at = (least[window] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(text[window]) != 0)]))
    first = window[new]
    owner = text[first]
    return owner, h[at[new]].view(np.int64), first - (ends - sizes)[owner], np.diff(np.append(new, len(window)))


_ANCHORS = {"key": pa.int64(), "doc": pa.int64(), "tkey": pa.int64(), "start": pa.int64(), "n": pa.int64()}
_ROW_SQL = "key long, doc long, tkey long, start long, n long"


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc"), text_key(text).alias("tkey"), text.alias("text"))


def _anchor_rows(rows: DataFrame) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch):
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            owner, key, start, n = anchors([t.encode().split() for t in batch.column(2).to_pylist()])
            return arrow(_ANCHORS, key, ids[owner], keys[owner], start, n) if len(owner) else None

        return step

    return map_batches(rows.where("doc is not null and text is not null"), make, _ROW_SQL)


# who holds a key first -------------------------------------------------------------------
_REFERENCE, _PROBE, _OPEN, _EDGE = range(4)
_HELD = {"kind": pa.int32(), **_ANCHORS, "first": pa.int64(), "shard": pa.int64()}


def _shard(tkey: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A shard of a document: which of its rows, and which block of words."""
    h = (tkey.view(np.uint64) ^ (start // BLOCK).astype(np.uint64)) * np.uint64(_BASE)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


class _Reader:
    """Reads rows in order of (key, doc, tkey, start) and names the first document of each key.

    Rows of the first key of a task are *open*: their key may have begun in an earlier task. So are those
    of its last key as long as one document holds it. An *edge* row tells of each such key.
    """

    def __init__(self):
        self.key, self.leading, self.waiting = None, False, []

    def read(self, key, doc, tkey, start, n):
        if not len(key):
            return
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        first, shard = doc[begin].copy(), _shard(tkey[begin], start[begin])
        opened = np.zeros(len(begin), bool)
        if self.key is None:
            opened[0] = self.leading = True
            self._begin(key, doc, tkey, start, 0)
        elif key[0] == self.key:
            first[0], shard[0], opened[0] = self.first, self.shard, self.leading
        else:
            yield from self._end()
        follows = doc > first[group]
        shared = np.logical_or.reduceat(follows, begin)
        if self.key == key[0] and not self.leading and (shared[0] or not self.waiting):
            shared[0] = True  # its first document's rows were given or are given now
            yield from self.waiting
            self.waiting = []
        last = begin[-1]
        shown = (shared | opened)[group]
        if not shown[-1]:
            kept = slice(last, None)
            self.waiting = (self.waiting if len(begin) == 1 and self.key == key[0] else []) + [
                self._rows(np.full(len(key) - last, _REFERENCE), key[kept], doc[kept], tkey[kept], start[kept], n[kept], first[group[kept]], shard[group[kept]])]
        elif len(begin) > 1:
            self.waiting = []
        kind = np.where(opened[group], _OPEN, np.where(follows, _PROBE, _REFERENCE))
        if shown.any():
            yield self._rows(kind[shown], key[shown], doc[shown], tkey[shown], start[shown], n[shown], first[group[shown]], shard[group[shown]])
        if len(begin) > 1 or self.key != key[0]:
            if self.leading and len(begin) > 1:
                self.most = max(self.most, int(doc[:begin[1]].max()))
                yield self._edge()
            self.leading = self.leading and len(begin) == 1
            if not self.leading:
                self._begin(key, doc, tkey, start, last)
        self.most = max(self.most, int(doc[-1]))

    def _begin(self, key, doc, tkey, start, at):
        self.key, self.first, self.most = key[at], int(doc[at]), int(doc[at])
        self.place, self.shard = (int(tkey[at]), int(start[at])), int(_shard(tkey[at:at + 1], start[at:at + 1])[0])

    def _rows(self, kind, *columns):
        return arrow(_HELD, kind.astype(np.int32), *columns)

    def _edge(self):
        return arrow(_HELD, [_EDGE], [self.key], [self.first], [self.place[0]], [self.place[1]], [0], [self.most], [self.shard])

    def _end(self):
        """The key ended inside the task: a leading key tells its edge, rows that wait have no follower."""
        if self.leading:
            yield self._edge()
            self.leading = False
        self.waiting = []

    def close(self):
        if self.key is None:
            return
        for rows in self.waiting:
            yield rows.set_column(0, "kind", pa.array([_OPEN] * rows.num_rows, pa.int32()))
        yield self._edge()


def holders(rows: DataFrame) -> DataFrame:
    """Rows ``key, doc, tkey, start, n`` of keys that two documents hold, with ``kind, first, shard``.

    ``first`` is the smallest document of the key and ``shard`` the place of its first row; ``kind`` is 0 for rows of that document and 1
    for later ones. One exchange by ranges, so that no key is one task's work; the table of edges, which is broadcast, has two rows a task.
    """
    by = ["key", "doc", "tkey", "start"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, "n")

    def run(batches):
        reader = _Reader()
        for batch in batches:
            yield from reader.read(*[c.to_numpy(zero_copy_only=False) for c in batch.columns])
        yield from reader.close()

    read = materialise(dealt.mapInArrow(run, f"kind int, {_ROW_SQL}, first long, shard long"), "holders")
    edges = read.where(f"kind = {_EDGE}").groupBy("key").agg(
        F.min(F.struct("doc", "tkey", "start", "shard")).alias("least"), F.max("first").alias("most"))
    edges = edges.where("most > least.doc").select("key", F.col("least.doc").alias("least_doc"), F.col("least.shard").alias("least_shard"))
    edges = edges.withColumnRenamed("key", "edge")
    met = read.where(f"kind < {_EDGE}").join(F.broadcast(edges), F.expr(f"key = edge and kind = {_OPEN}"), "left")  # two rows a task
    opened, later = F.col("kind") == _OPEN, F.col("doc") > F.col("least_doc")
    return met.where(f"kind < {_OPEN} or edge is not null").select(
        F.when(~opened, F.col("kind")).when(later, _PROBE).otherwise(_REFERENCE).alias("kind"), "key", "doc", "tkey", "start", "n",
        F.when(opened, F.col("least_doc")).otherwise(F.col("first")).alias("first"),
        F.when(opened, F.col("least_shard")).otherwise(F.col("shard")).alias("shard"))


# automata --------------------------------------------------------------------------------
class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next, self.link, self.size = [{}], [-1], [0]

    def _state(self, size: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The state of the words up to ``word`` after ``p``: ``q``, or a copy of it of that length."""
        following, link, size = self.next, self.link, self.size
        if size[q] == size[p] + 1:
            return q
        copy = self._state(size[p] + 1, following[q].copy(), link[q])
        while p >= 0 and following[p].get(word) == q:
            following[p][word] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, words) -> None:
        following, link = self.next, self.link
        last = 0
        for word in words:
            p = last
            known = following[p].get(word)
            if known is not None:
                last = self._split(p, known, word)
                continue
            last = self._state(self.size[p] + 1, {}, 0)
            while p >= 0 and word not in following[p]:
                following[p][word] = last
                p = link[p]
            link[last] = 0 if p < 0 else self._split(p, following[p][word], word)

    def matches(self, words) -> list[int]:
        """For each word the length of the longest match that ends with it."""
        following, link, size = self.next, self.link, self.size
        state, length, found = 0, 0, []
        for word in words:
            to = following[state].get(word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = following[state].get(word)
            if to is not None:
                state, length = to, length + 1
            found.append(length)
        return found


def _runs(flags: list[bool]) -> list[tuple[int, int]]:
    """``(begin, length)`` of the stretches of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


_PASSAGES = {"first": pa.int64(), "shard": pa.int64(), "kind": pa.int32(), "doc": pa.int64(), "tkey": pa.int64(), "start": pa.int64(), "words": pa.string()}
_FOUND = {"key": pa.int64(), "doc": pa.int64(), "tkey": pa.int64(), "start": pa.int64(), "n": pa.int64()}


def _passages(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The words of the windows in ``held``: windows of one shard that follow each other form one passage."""
    spots = held.groupBy("doc", "tkey").agg(F.collect_list(F.struct("first", "shard", "kind", "start", "n")).alias("spots"))
    met = sifted(rows, spots, True).join(spots, ["doc", "tkey"]).select("doc", "tkey", "text", "spots")

    def make():
        def step(batch: pa.RecordBatch):
            out = []
            for doc, tkey, text, spots in zip(*[c.to_pylist() for c in batch.columns]):
                words = text.encode().split()
                last = None
                for first, shard, kind, start, n in sorted(tuple(s.values()) for s in spots):
                    if last and last[:3] == [first, shard, kind] and start <= last[4]:
                        last[4] = max(last[4], start + n)
                        continue
                    if last:
                        out.append(last)
                    last = [first, shard, kind, start, start + n, doc, tkey, words]
                if last:
                    out.append(last)
            if not out:
                return None
            return arrow(_PASSAGES, *zip(*(
                (f, s, k, doc, tkey, a, b" ".join(words[a:b + WINDOW - 1]).decode()) for f, s, k, a, b, doc, tkey, words in out)))

        return step

    return map_batches(met, make, "first long, shard long, kind int, doc long, tkey long, start long, words string")


def _streamed(passages: DataFrame, hot: DataFrame) -> DataFrame:
    """``key, doc, tkey, start, n``: windows found in the shard (key null), and the others one by one with a hash of their words."""
    met = passages.join(F.broadcast(hot), ["first", "shard"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.when(F.col("kind") == _REFERENCE, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("doc", "tkey"), F.col("salts")).cast("int")))
    place = ["first", "shard", "salt"]
    met = met.withColumn("salt", F.explode(salt)).repartition(*place).sortWithinPartitions(*place, "kind", "doc", "tkey", "start")

    def run(batches):
        now, automaton = None, None
        for batch in batches:
            found, rest = [], []
            for first, shard, salt, kind, doc, tkey, start, words in zip(*[c.to_pylist() for c in batch.columns]):
                if (first, shard, salt) != now:
                    now, automaton = (first, shard, salt), Automaton()
                words = words.encode().split()
                if kind == _REFERENCE:
                    automaton.add(words)
                    continue
                inside = [m >= WINDOW for m in automaton.matches(words)[WINDOW - 1:]]
                found += [(None, doc, tkey, start + a, n) for a, n in _runs(inside)]
                rest += [(xxhash.xxh3_64_intdigest(b" ".join(words[i:i + WINDOW])) - (1 << 63), doc, tkey, start + i, 1)
                         for i, there in enumerate(inside) if not there]
            if found or rest:
                yield arrow(_FOUND, *zip(*found, *rest))

    return met.select(*place, "kind", "doc", "tkey", "start", "words").mapInArrow(run, _ROW_SQL)


def sifted(rows: DataFrame, keys: DataFrame, wanted: bool) -> DataFrame:
    """The rows that may be among ``keys(doc, tkey)`` (``wanted``), or those that are surely not.

    A bitmap of 16 bits a key travels to the scan, up to 64 MB; beyond that it only lets more rows through.
    """
    count = keys.count()
    size = min(1 << 29, max(1 << 15, 1 << (16 * count).bit_length()))
    place = F.pmod(F.xxhash64("doc", "tkey"), F.lit(size))
    bits = keys.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    met = rows.withColumn("p", place).withColumn("bucket", F.expr("p div 32768")).join(F.broadcast(bits), "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast((p % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    there = F.coalesce(F.call_function("shiftright", byte, (F.col("p") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    there = there & F.col("doc").isNotNull()
    return met.where(there if wanted else ~there).drop("p", "bucket", "bits")


def removed_windows(rows: DataFrame) -> DataFrame:
    """``doc, tkey, start, n``: runs of windows to remove."""
    held = holders(_anchor_rows(rows))
    shards = held.where(f"kind = {_PROBE}").groupBy("first", "shard").agg(F.count("*").alias("probes"))
    shards = materialise(shards, "shard-sizes")
    total = shards.agg(F.sum("probes")).first()[0] or 0
    room = max(_HOT, total >> 20)
    hot = shards.where(F.col("probes") > room).select("first", "shard", F.ceil(F.col("probes") / room).cast("int").alias("salts"))
    streamed = materialise(_streamed(_passages(rows, held), hot), "streamed")
    found = streamed.where("key is null").drop("key")
    rest = holders(streamed.where("key is not null")).where(f"kind = {_PROBE}")
    return materialise(found.unionByName(rest.select(*found.columns)), "removed-windows")


_OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}


def _kept(rows: DataFrame, digests: bool) -> DataFrame:
    """The words of each row that no run of ``spots`` covers."""
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc, text, spots in zip(*[c.to_pylist() for c in batch.columns]):
                words = (text or "").encode().split()
                kept, end = [], 0
                for start, n in sorted((s["start"], s["n"]) for s in spots or ()):
                    kept += words[end:start]
                    end = max(end, start + n + WINDOW - 1)
                kept += words[end:]
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest() if digests else joined.decode()))
            return arrow(_OUT, *(zip(*out) if out else [[]] * 4))

        return step

    last = "kept_sha256" if digests else "kept"
    return map_batches(rows.select("doc", "text", "spots"), make, f"doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", last)


def _deduplicated(docs: DataFrame, digests: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = _rows(docs)
    spots = removed_windows(rows).groupBy("doc", "tkey").agg(F.collect_list(F.struct("start", "n")).alias("spots"))
    spots = materialise(spots, "removed-spots")
    kind = "array<struct<start:bigint,n:bigint>>"
    clean = sifted(rows, spots, False).withColumn("spots", F.lit(None).cast(kind))
    cut = sifted(rows, spots, True).join(spots, ["doc", "tkey"], "left")
    return _kept(clean.select("doc", "text", "spots").unionByName(cut.select("doc", "text", "spots")), digests)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words of each row that stay, joined by one space."""
    return _deduplicated(docs, False)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """The same with the SHA-256 of the kept words in place of them."""
    return _deduplicated(docs, True)
