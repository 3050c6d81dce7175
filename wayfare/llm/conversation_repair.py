"""Repair of conversation structure as a lightest derivation.

A conversation's turns, in order, must read ``(s?(ua)+)?`` in role initials. Edits: Keep a turn (K, cost 0),
give it the role user or assistant (R, 2), Delete it (D, 3; the only edit of a blank or repeated turn),
Insert an empty user or assistant turn anywhere (I, 2). A truncated turn that stays adds 1. The edits'
initials in order are the *audit*; of the cheapest repairs that of the least audit is taken.

A repair is a derivation in a weighted hypergraph. An item says that the turns of a span take the pattern
from one state to another; its weight is (cost, turns covered, audit). One deduction adds an edit to an
item, another joins the items of two neighbouring spans. Knuth's agenda pops the lightest item, which is
final because every deduction is monotone and never lighter than its parts: costs and turns only add up, an
audit is only extended, and two audits of one span and cost never are prefixes of each other, since an
insertion costs. It ends when the goal item is final (:func:`lightest`).

On Spark no conversation is one task's work up to the audit. Turns travel as keys (a hash of the text
in place of the text): equal turns collapse with partial counts, the first of each (role, text) is a
minimum, and the marks are dealt by *ranges* of (conversation, turn), so a conversation of any length is
spread in order over tasks. A task derives the items of its pieces in blocks of ``_BLOCK`` turns; a
piece at the edge of a task keeps the items of all states, and the last stage joins the pieces, at most
one per task, by the same agenda. Texts move once: they are read in order past the audit.
SHA-256 has no parallel form, so the hash of one conversation is one task's stream, in constant memory.

A null role or text is one space; null turns come first; a null ``conv_id`` is a conversation. Turns of
equal number go by role, then by a hash of the text. An empty role has no initial: it can be re-roled or deleted.
Repeated rows are repeated turns. Conversations without rows have zeros, an empty audit and an empty
text. Very long texts are only hashed and passed on. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, small_batches

_WHITE = " \t\n\x0b\x0c\r"
_BLOCK = 48
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. A repair goes from 0 to 0 or 3.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_TURN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
STATES, GOALS = (0, 1, 2, 3), ((0, 0), (0, 3))
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_LEGAL = {"su", "ua", "au"}


def lightest(axioms, deduce, goals=()) -> dict:
    """Knuth's agenda: the weight of each final item, until one of ``goals`` is final.

    ``axioms`` are (weight, item); ``deduce(item, weight, chart)`` yields the (weight, item) that follow from
    the item just finalised and the chart. Weights must not fall along a deduction.
    """
    agenda, chart = list(axioms), {}
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = weight
        if item in goals:
            break
        for after in deduce(item, weight, chart):
            if after[1] not in chart:
                heapq.heappush(agenda, after)
    return chart


def span_items(turns: list[tuple[str, bool, bool]], starts) -> dict:
    """``(p, q) -> (cost, turns, audit)`` over ``turns`` of (initial, must go, truncated)."""
    n, found = len(turns), {}

    def deduce(item, weight, chart):
        k, q = item
        cost, _, audit = weight
        to = _TURN[q][1]
        yield (cost + INSERT, k, audit + "I"), (k, to)
        if k == n:
            return
        initial, must_go, truncated = turns[k]
        yield (cost + DELETE, k + 1, audit + "D"), (k + 1, q)
        if not must_go:
            kept = _NEXT.get((q, initial))
            if kept is not None:
                yield (cost + TRUNCATED * truncated, k + 1, audit + "K"), (k + 1, kept)
            yield (cost + REROLE + TRUNCATED * truncated, k + 1, audit + "R"), (k + 1, to)

    for p in starts:
        goals = ((n, 0), (n, 3)) if starts == (0,) else ()
        chart = lightest([((0, 0, ""), (0, p))], deduce, goals)
        found |= {(p, q): chart[n, q] for q in STATES if (n, q) in chart}
    return found


def joined_items(spans: list[dict], goals=()) -> dict:
    """The items of neighbouring spans joined two by two up a balanced tree."""
    width = [len(spans)]
    while width[-1] > 1:
        width.append((width[-1] + 1) // 2)
    top = len(width) - 1
    by_node: dict[tuple, dict] = {}

    def deduce(item, weight, chart):
        level, k, p, q = item
        by_node.setdefault((level, k), {})[p, q] = weight
        if level == top:
            return
        if k ^ 1 >= width[level]:
            yield weight, (level + 1, k // 2, p, q)
            return
        cost, turns, audit = weight
        for (a, b), (c, t, s) in by_node.get((level, k ^ 1), {}).items():
            if k % 2 == 0 and a == q:
                yield (cost + c, turns + t, audit + s), (level + 1, k // 2, p, b)
            elif k % 2 and b == p:
                yield (cost + c, turns + t, s + audit), (level + 1, k // 2, a, q)

    axioms = [(w, (0, k, p, q)) for k, span in enumerate(spans) for (p, q), w in span.items()]
    chart = lightest(axioms, deduce, {(top, 0, p, q) for p, q in goals})
    return {(p, q): w for (level, k, p, q), w in chart.items() if level == top}


def piece_items(turns: list, whole: bool) -> dict:
    """The items of a piece of a conversation; of a whole one the goals suffice."""
    if len(turns) <= _BLOCK:
        return span_items(turns, (0,) if whole else STATES)
    spans = [span_items(turns[i:i + _BLOCK], STATES) for i in range(0, len(turns), _BLOCK)]
    return joined_items(spans, GOALS if whole else ())


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the damage that the hash of ``conv_id:turn`` says.

    0 drops the row (``copies`` 0), 1 empties the text, 2 removes its stops, 3 repeats it, 4 makes it the user's.
    """
    def filled(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


_CONV, _ORDER = ["cn", "c"], ["tk", "t", "role", "h1", "h2"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with keys that hold no nulls, and two hashes in place of the text for order and equality."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    return rows.select(
        F.col("conv_id").isNull().alias("cn"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"),
        F.col("turn").isNotNull().alias("tk"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.xxhash64(text).alias("h1"),
        F.hash(text, F.length(text)).alias("h2"), text.alias("text"), copies.alias("copies"))


def _marks(rows: DataFrame) -> DataFrame:
    """One row per distinct turn: initial, faults, count, and whether its role and text come first here."""
    bare = F.rtrim(F.col("text"), F.lit(_WHITE))
    keys = rows.where("copies > 0").select(
        *_CONV, *_ORDER, "copies", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    turns = keys.groupBy(*_CONV, *_ORDER).agg(
        F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    same = [*_CONV, "role", "h1", "h2"]
    first = turns.groupBy(*same).agg(F.min(F.struct("tk", "t")).alias("at")).select(
        *same, F.col("at.tk").alias("tk"), F.col("at.t").alias("t"), F.lit(True).alias("first"))
    return turns.join(first, [*_CONV, *_ORDER], "left").withColumn("first", F.col("first").isNotNull())


_PIECE = {"cn": pa.bool_(), "c": pa.int64(), "piece": pa.int64(), "counts": pa.list_(pa.int64()), "ends": pa.list_(pa.string()),
          "span": pa.list_(pa.int64()), "items": pa.list_(pa.list_(pa.int64())), "audits": pa.list_(pa.string())}
_PIECE_SQL = ("cn boolean, c long, piece long, counts array<long>, ends array<string>, span array<long>, "
              "items array<array<long>>, audits array<string>")


def _piece(marks: list[tuple], whole: bool) -> tuple:
    """The counts, ends and items of consecutive turns of one conversation."""
    blank = repeated = cut = illegal = distinct = 0
    turns, before, last, low = [], None, None, None
    for tk, t, role, n, is_blank, is_cut, first in marks:
        initial = role[:1]
        if before is not None and before + initial not in _LEGAL:
            illegal += 1
        illegal += n - 1
        before = initial
        fresh = 0 if is_blank or not first else 1
        blank += n if is_blank else 0
        repeated += 0 if is_blank else n - fresh
        cut += fresh and is_cut
        turns += [(initial, False, is_cut)] * fresh + [(initial, True, False)] * (n - fresh)
        if tk:
            low = t if low is None else low
            distinct += t != last
            last = t
    items = piece_items(turns, whole)
    ends = [marks[0][2][:1], before]
    span = [] if low is None else [low, last, distinct]
    return ([blank, repeated, cut, illegal], ends, span, [[p, q, w[0], w[1]] for (p, q), w in items.items()],
            [w[2] for w in items.values()])


def _pieces(marks: DataFrame) -> DataFrame:
    """The pieces of each conversation, from marks dealt by ranges."""
    by = [*_CONV, *_ORDER]
    dealt = marks.repartitionByRange(*by).sortWithinPartitions(*by).select(
        *_CONV, "tk", "t", "role", "n", "blank", "cut", "first")

    def run(batches):
        part = TaskContext.get().partitionId()
        held, key, earlier = [], None, False

        def out(whole):
            return arrow(_PIECE, *[[v] for v in (*key, part, *_piece(held, whole))])

        for batch in batches:
            for cn, c, *mark in zip(*[col.to_pylist() for col in batch.columns]):
                if (cn, c) != key:
                    if key is not None:
                        yield out(earlier)  # the first piece of a task may have begun in another
                        earlier = True
                    held, key = [], (cn, c)
                held.append(tuple(mark))
        if key is not None:
            yield out(False)

    return dealt.mapInArrow(run, _PIECE_SQL)


def _report(pieces: list[dict]) -> tuple:
    """``gaps, blank, duplicate, truncated, illegal, cost, audit`` of a conversation from its pieces in order."""
    if not pieces:
        return (0, 0, 0, 0, 0, 0, "")
    counts = [sum(p["counts"][k] for p in pieces) for k in range(4)]
    counts[3] += sum(a["ends"][1] + b["ends"][0] not in _LEGAL for a, b in zip(pieces, pieces[1:]))
    spans = [p["span"] for p in pieces if p["span"]]
    gaps = 0
    if spans:
        distinct = sum(s[2] for s in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        gaps = spans[-1][1] - spans[0][0] + 1 - distinct
    items = joined_items([{(p, q): (cost, n, s) for (p, q, cost, n), s in zip(x["items"], x["audits"])} for x in pieces], GOALS)
    cost, _, audit = min(items[g] for g in GOALS if g in items)
    return (gaps, *counts, cost, audit)


class _Rewriter:
    """Reads a conversation's turns in order past its audit and gives the repaired lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = _TURN[self.state]
            self.at += 1
            yield f"{role}:"

    def turn(self, role: str, text: str):
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _NEXT[self.state, role[:1]]
            yield f"{role}:{text}"
        elif edit == "R":
            role, self.state = _TURN[self.state]
            yield f"{role}:{text}"

    def end(self):
        yield from self._inserted()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repaired(rows: DataFrame, digests: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    keyed = _keyed(rows)
    pieces = _pieces(_marks(keyed)).select(
        *_CONV, F.lit(0).alias("kind"), F.lit(True).alias("tk"), F.col("piece").alias("t"), F.lit("").alias("role"),
        F.lit(0).cast("long").alias("h1"), F.lit(0).alias("h2"), F.lit(0).cast("long").alias("copies"),
        F.lit(None).cast("string").alias("text"), F.struct("counts", "ends", "span", "items", "audits").alias("piece"))
    texts = keyed.select(
        *_CONV, F.lit(1).alias("kind"), *_ORDER, "copies", F.when(F.col("copies") > 0, F.col("text")).alias("text"),
        F.lit(None).cast(pieces.schema["piece"].dataType).alias("piece"))
    both = pieces.unionByName(texts).repartition(*_CONV).sortWithinPartitions(*_CONV, "kind", *_ORDER)
    last = "repaired_sha256" if digests else "repaired"
    types = {"conv_id": pa.int64(), **{k: pa.int64() for k in _COUNTS}, "audit": pa.string(), last: pa.string()}

    def run(batches):
        key, pieces, rewriter, report, sink = None, [], None, None, None

        class Lines:
            def __init__(self):
                self.hash, self.parts, self.n = hashlib.sha256(), [], 0

            def add(self, lines):
                for line in lines:
                    if digests:
                        self.hash.update((b"\n" if self.n else b"") + line.encode())
                    else:
                        self.parts.append(line)
                    self.n += 1

            def result(self):
                return self.hash.hexdigest() if digests else "\n".join(self.parts)

        def begin():
            report = _report(pieces)
            return report, _Rewriter(report[-1]), Lines()

        def finish():
            nonlocal report, rewriter, sink
            if rewriter is None:
                report, rewriter, sink = begin()
            sink.add(rewriter.end())
            return (None if key[0] else key[1], *report, sink.result())

        for batch in batches:
            done = []
            cols = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for cn, c, kind, role, copies, text, piece in zip(*cols):
                if (cn, c) != key:
                    if key is not None:
                        done.append(finish())
                    key, pieces, rewriter = (cn, c), [], None
                if kind == 0:
                    pieces.append(piece)
                    continue
                if rewriter is None:
                    report, rewriter, sink = begin()
                for _ in range(copies):
                    sink.add(rewriter.turn(role, text))
            if done:
                yield arrow(types, *zip(*done))
        if key is not None:
            yield arrow(types, *zip(finish()))

    return both.select(*_CONV, "kind", "role", "copies", "text", "piece").mapInArrow(
        run, f"conv_id long, {', '.join(f'{k} long' for k in _COUNTS)}, audit string, {last} string")


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id``, the counts of faults, ``cost, audit`` and the ``repaired`` lines of each conversation.

    ``rows``: ``conv_id, turn, role, text``; with a column ``copies`` a row stands that many times (0: its
    conversation is named, but the row is not there).
    """
    return _repaired(rows, False)


def repair_digests(rows: DataFrame) -> DataFrame:
    """The same with the SHA-256 of the repaired lines in place of them."""
    return _repaired(rows, True)
