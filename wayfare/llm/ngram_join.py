"""Set-similarity self-join of word n-grams by token-combination prefixes.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. Documents with equal sets
are one *class* first (by a 128-bit hash of the sorted set); the join runs over classes.

Tokens are ordered: rare ones first, then frequent ones, by hash within. With similarity ``s``, at
most ``m = n - ceil(s * n)`` of a set's ``n`` tokens are missing in a partner, so the first ``k``
common tokens lie in the first ``m + k`` tokens of both. If the first common token is rare, both sets
index it alone, in their first ``m + 1``. If not, all common tokens are frequent; those fall into
``c`` classes by hash, so among the first ``c + 1`` two are of one class, and both sets index that
pair, in prefixes extended to ``m + c + 1``. ``c`` grows with the set (one class per 16 tokens of a
size level), so pairs stay in proportion to the set; a set near the foot of its level also indexes the
level below, so partners always share one level.

A token is frequent if ``max(8, shingles / 2**23)`` documents hold it by a count over all documents
that leaves out what is single within a block of some million shingles. So at most ``2**23`` tokens
are frequent (64 MB to the driver and to tasks), and the count only steers the order: any order gives
the same result.

Candidates pass an exact filter (sizes; parity bitmaps, whose differing bits cannot outnumber the
differing tokens; and the place of the shared token, beyond which the rest must suffice) and are verified on the texts' own shingles. :mod:`linking` spares pairs inside
components. Texts reach the verification through a Bloom filter of fixed size, so that only
candidates' texts are shuffled.

Null, empty and wordless texts have no shingles and are components of their own; so are rows with a
null id (their component is null). Rows that share an id stand for one document in links; each keeps
its own set size. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import LOWER, arrow, map_batches, only_asked, per_worker, text_key
from .linking import link, membership_bits, parity_words, shared_only

SIZE = 5
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def need(n: int, percent: int) -> int:
    """The least common tokens of a set of ``n`` with any set at least that similar."""
    return -(-percent * n // 100)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (unsigned 64-bit)."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SIZE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = len(h) - SIZE + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(SIZE):
        mixed += (h[k:k + n] ^ np.uint64(_MIX[k])) * np.uint64(_MIX[k] | 1)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def parity_bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens of each slot; between 256 bits and 16,384, about two per token."""
    bits = 256
    while bits < min(2 * len(tokens), 16_384):
        bits *= 2
    parity = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def fewest_differences(a: bytes, b: bytes) -> int:
    """A lower bound on the tokens in just one of two sets, from their parity bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):  # slots are residues, so halves add up
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _classes(n: int) -> tuple[int, int]:
    level = max(n, 1).bit_length()
    return level, max(1, (1 << level) // 32)


def placed_signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix signatures of a set, single rare tokens and same-class pairs of frequent ones, and the room of each.

    The room bounds the common tokens of a pair that this signature must find. Its first common token is the signature, so
    all others come later; a pair's second token is among the first ``c + 1`` common ones, so at most ``c`` come before it.
    """
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    order = tokens * np.uint64(_MIX[1])
    order ^= order >> np.uint64(31)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
    else:
        often = np.zeros(n, bool)
    rank = np.lexsort((order, often))
    ordered, often = tokens[rank], often[rank]
    m = n - need(n, percent)
    found, room = [ordered[:m + 1][~often[:m + 1]]], [n - np.flatnonzero(~often[:m + 1])]
    levels = {_classes(n), _classes(need(n, percent))}
    for level, c in sorted(levels):
        reach = min(n, m + c + 1)
        part, place = ordered[:reach][often[:reach]], np.flatnonzero(often[:reach])
        kind = (part >> np.uint64(8)) % np.uint64(c)
        by = np.argsort(kind, kind="stable")
        part, kind, place = part[by], kind[by], place[by]
        # All pairs inside a class: partners at distance 1, 2, ... while the class lasts.
        for gap in range(1, len(part)):
            same = kind[gap:] == kind[:-gap]
            if not same.any():
                break
            x, y = part[gap:][same], part[:-gap][same]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            mixed = (lo ^ np.uint64(_MIX[2])) * np.uint64(_MIX[3]) + hi * np.uint64(_MIX[0]) + np.uint64(level)
            found.append((mixed ^ (mixed >> np.uint64(30))) * np.uint64(_MIX[4] | 1))
            room.append(n - place[gap:][same] + c)  # within a class places ascend
    found, at = np.unique(np.concatenate(found), return_inverse=True)
    most = np.zeros(len(found), np.int64)
    np.maximum.at(most, at, np.concatenate(room))
    return found, np.minimum(most, n)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The signatures alone."""
    return placed_signatures(tokens, frequent, percent)[0]


_COUNTS = {"token": pa.int64(), "n": pa.int64(), "total": pa.int64()}
_BLOCK = 4_000_000


def frequent_tokens(docs: DataFrame, least: int = 8, most: int = 1 << 23) -> np.ndarray:
    """Sorted tokens that many documents hold; see the module's text for the bound."""
    def count(batches):
        parts, size = only_asked(list), 0

        def flush():
            tokens, times = np.unique(np.concatenate(parts), return_counts=True)
            often = times > 1
            n = int(often.sum())
            yield arrow(_COUNTS, tokens[often].view(np.int64), times[often], [0] * n)
            yield arrow(_COUNTS, [None], [0], [size])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = shingle_set(text)
                parts.append(tokens)
                size += len(tokens)
            if size > _BLOCK:
                yield from flush()
                parts, size = [], 0
        if parts:
            yield from flush()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "token long, n long, total long")
    counted = materialise(counted.groupBy("token").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
                          .where(f"n >= {least} or token is null"), "token-counts")
    shingles = counted.where("token is null").agg(F.sum("total")).first()[0] or 0
    floor = max(least, -(-shingles // most))
    found = [r[0] for r in counted.where(f"token is not null and n >= {floor}").select("token").toLocalIterator()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


_META = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_hash": pa.binary(), "key": pa.int64(),
         "bitmap": pa.binary(), "marks": pa.list_(pa.int64()), "sigs": pa.list_(pa.int64()), "rooms": pa.list_(pa.int32())}


def describe(docs: DataFrame, frequent, percent: int) -> DataFrame:
    """One row per document: set size, hash of the set, parity bitmap and prefix signatures."""
    def make():
        often = frequent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, hashes, keys, bitmaps, marks, sigs, rooms = [], [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text)
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                sizes.append(len(tokens))
                hashes.append(digest)
                keys.append(int.from_bytes(digest[:8], "little", signed=True))
                bitmaps.append(parity_bitmap(tokens) if len(tokens) else b"")
                marks.append(parity_words(tokens))
                found, room = placed_signatures(tokens, often, percent)
                sigs.append(found.view(np.int64))
                rooms.append(room)
            return arrow(_META, batch.column(0), sizes, hashes, keys, bitmaps, marks, sigs, rooms)

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(
        rows, make, "doc_id long, n_shingles long, set_hash binary, key long, bitmap binary, marks array<long>, "
                    "sigs array<long>, rooms array<int>")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes whose sizes and bitmaps allow the similarity."""
    def side(name: str) -> DataFrame:
        return classes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bitmap").alias(f"bits_{name}"))

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            rows = zip(*[batch.column(k).to_pylist() for k in range(2, 6)])
            for x, y, bits_x, bits_y in rows:
                # 100 * common >= percent * union, so common >= percent * (x + y) / (100 + percent)
                common = -(-percent * (x + y) // (100 + percent))
                keep.append(fewest_differences(bits_x, bits_y) <= x + y - 2 * common)
            return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return step

    return map_batches(met.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), make, "a long, b long")


def _may_be_among(rows: DataFrame, key, ids: DataFrame) -> DataFrame:
    """``rows`` with ``among``: true where ``key`` (long) is one of ``ids``, and in a few rows more. Nothing but a Bloom filter is sent."""
    bits = F.broadcast(membership_bits(ids))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 26))
    met = rows.withColumn("p", place).withColumn("bucket", F.bitmap_bucket_number("p") - 1).withColumn("bit", F.bitmap_bit_position("p"))
    met = met.join(bits, "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.withColumn("among", F.coalesce(held, F.lit(False))).drop("p", "bucket", "bit", "bits")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, text`` of the documents among ``ids`` and a few more, without a shuffle of the others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return _may_be_among(rows, "id", ids).where("among").select("id", "text")


def _one_row_per_class(full: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of the smallest id of each class. Only rows whose set may occur twice are shuffled."""
    twice = classes.where("copies > 1")
    met = _may_be_among(full, F.xxhash64("set_hash"), twice.select(F.xxhash64("set_hash").alias("id")))
    first = classes.select("set_hash", F.col("id").alias("doc_id"))
    alone = met.where("not among").drop("among")
    return alone.unionByName(met.where("among").drop("among").join(first, ["set_hash", "doc_id"], "left_semi").select(*alone.columns))


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The written pairs whose texts reach the similarity; only the texts of pairs are shuffled."""
    def make():
        known = per_worker("shingle sets", dict)

        def tokens(doc_id: int, text: str) -> np.ndarray:
            key = (doc_id, len(text), hash(text))
            if key not in known:
                if len(known) >= 256:
                    known.clear()
                known[key] = shingle_set(text)
            return known[key]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, b, x, y in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                s, t = tokens(a, x), tokens(b, y)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return step

    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    met = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    met = met.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return map_batches(met.select("a", "b", "text_a", "text_b"), make, "a long, b long").distinct()


#: Tokens and documents of a block when the links inside a component are counted.
_BLOCK_TOKENS, _BLOCK_DOCS, _VOCABULARY = 1 << 20, 1024, 2048


def block_links(ids: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers of links between the lower and the upper of at most two blocks, or inside the only one.

    All pairs by products of token incidence, a slice of the vocabulary at a time.
    """
    held = np.array([len(s) > 0 for s in sets], bool)
    ids, blocks, sets = ids[held], blocks[held], [s for s in sets if len(s)]
    if not sets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(s) for s in sets])
    sides = [np.flatnonzero(blocks == b) for b in (blocks.min(), blocks.max())]
    place = [np.full(len(sets), -1), np.full(len(sets), -1)]
    for at, side in zip(place, sides):
        at[side] = np.arange(len(side))
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), sizes), times[token] > 1
    token, owner = np.unique(token[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    common = np.zeros([len(side) for side in sides], np.float32)  # whole numbers below 2 ** 24
    for start in range(0, int(token[-1]) + 1 if len(token) else 0, _VOCABULARY):
        part = slice(*np.searchsorted(token, [start, start + _VOCABULARY]))
        marks = []
        for at, side in zip(place, sides):
            mine = at[owner[part]]
            marks.append(np.zeros((len(side), _VOCABULARY), np.float32))
            marks[-1][mine[mine >= 0], token[part][mine >= 0] - start] = 1
        common += marks[0] @ marks[1].T
    common = common.astype(np.int64)
    left, right = sides
    met = 100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common)
    x, y = np.nonzero(met & (ids[left][:, None] != ids[right][None, :]))
    pairs = np.unique(np.stack([ids[left][x], ids[right][y]]), axis=1)
    ends = pairs[0] if blocks.min() == blocks.max() else pairs.ravel()
    return np.unique(ends, return_counts=True)


def _all_links(linked: DataFrame, sizes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``id, component, n_links`` with all links, of which ``linked`` has those that were compared.

    A link never leaves its component, so all pairs inside components are all candidates. A component is cut into blocks of
    bounded size, and each pair of blocks is a group of its own that counts in place: no pair is ever a row. Components whose
    every pair is known to link are left as they are.
    """
    found = linked.join(sizes.select("id", "n"), "id").groupBy("component").agg(
        F.count("*").alias("m"), F.sum("n").alias("tokens"), F.sum("n_links").alias("ends"))
    found = found.where("ends < m * (m - 1)").select("component", F.ceil(F.greatest(
        F.col("tokens") / _BLOCK_TOKENS, F.col("m") / _BLOCK_DOCS)).cast("int").alias("blocks"))
    rows = linked.select("id", "component").join(found, "component").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = materialise(rows, "open-components")
    rows = rows.join(_texts(docs, rows.select("id")), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n = block_links(pdf["id"].to_numpy(), pdf["block"].to_numpy(), [shingle_set(t) for t in pdf["text"]], percent)
        return pd.DataFrame({"id": ids, "n": n})

    counted = rows.groupBy("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    counted = counted.applyInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_all"))
    return linked.join(counted, "id", "left").select("id", "component", F.coalesce("n_all", "n_links").alias("n_links"))


def ngram_components(docs: DataFrame, percent: int = 80, *, count_links: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest id reachable by links, a document's own if there is none.
    ``n_links`` counts all links to other sets; without ``count_links`` those that were needed to find the component.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs))
    meta = materialise(describe(docs, frequent, percent), "ngram-sets")
    frequent.destroy()  # workers forget it too
    full = meta.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    classes = materialise(classes, "set-classes")
    # One row per class: that of its smallest id (two sets under one id keep both rows apart by their hash).
    ones = _one_row_per_class(full, classes).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bitmap", "marks", "sigs", "rooms")
    rows = shared_only(ones.select(F.explode(F.arrays_zip("sigs", "rooms")).alias("s"), "id").select(
        F.col("s.sigs").alias("sig"), "id", F.col("s.rooms").alias("room")), pivots=True)
    ids = rows.select("id").distinct()
    described = materialise(ones.select("id", "n", "bitmap", "marks").join(ids, "id", "left_semi"), "candidate-sets")
    whole, meta = meta, materialise(meta.select("doc_id", "n_shingles", "set_hash"), "set-sizes")
    discard(whole)  # signatures and bitmaps are not needed any more
    full = meta.where("n_shingles > 0 and doc_id is not null")

    likely: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        likely.append(materialise(_plausible(pairs, described, percent), "likely-pairs"))
        for written in likely[:-1]:
            discard(written)
        return _verified(likely[-1], docs, percent)

    linked = link(rows, described.select("id", "n", "marks"), verify, percent)
    if count_links:
        linked = materialise(linked, "needed-links")
        linked = materialise(_all_links(linked, described, docs, percent), "all-links")
    for written in (*likely, described):
        discard(written)
    member = classes.join(linked, "id", "left").select(
        "set_hash", F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    with_class = full.select("doc_id", "n_shingles", "set_hash").join(member, "set_hash").drop("set_hash")
    alone = meta.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return with_class.unionByName(alone)


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that repeat another's text nearly or wholly: one row of each component stays.

    A row is known by its id and a hash of its text. Rows of one id with different texts are judged each for itself, and
    so are rows without an id. Rows equal in id and text are one document and stay or go alike; without an id they are copies,
    of which one stays. Rows that hold no word are no copies of each other and stay.
    """
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    key = F.struct(F.col("row.doc_id").cast("long").alias("i"), text_key(F.col("row.text")).alias("t"))
    keyed = whole.select("row", key.alias("key"))
    mine = F.xxhash64(F.col("key.i").isNull(), "key.i", "key.t")
    found = ngram_components(keyed.select(mine.alias("doc_id"), F.col("row.text").alias("text")), percent, count_links=False)
    found = found.where("n_shingles > 0").select("doc_id", "component_id").distinct()
    member = found.join(keyed.select(mine.alias("doc_id"), "key").distinct(), "doc_id")
    # The smallest id of a component stays; where none has an id, the smallest hash.
    order = F.struct(F.col("key.i").isNull().alias("last"), F.col("key.i").alias("i"), F.col("key.t").alias("t"))
    stays = member.groupBy("component_id").agg(F.min(order).alias("o")).select(
        F.xxhash64("o.last", "o.i", "o.t").alias("doc_id"))
    gone = materialise(member.select("doc_id").join(stays, "doc_id", "left_anti").select(F.col("doc_id").alias("gone_id")), "copies")
    kept = keyed.join(gone, mine == F.col("gone_id"), "left_anti")
    return _first_of_equal(kept).select(*[F.col(f"row.`{c}`") for c in names])


def _first_of_equal(keyed: DataFrame) -> DataFrame:
    """Of rows without an id that are equal in text and hold a word, one."""
    copies = F.col("key.i").isNull() & F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(r"[^ \x09-\x0D]")
    twice = keyed.where(copies).groupBy("key.t").agg(F.count("*").alias("n")).where("n > 1").select(F.col("t").alias("twice"))
    twice = materialise(twice, "equal-rows")
    if twice.isEmpty():
        return keyed
    same = copies & (F.col("key.t") == F.col("twice"))
    alone = keyed.join(twice, same, "left_anti").select("row")
    ones = keyed.join(twice, same, "left_semi").groupBy("key.t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return alone.unionByName(ones.select("row"))
