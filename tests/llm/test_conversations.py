"""Conversation repair against all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from wayfare.llm import conversation_repair as cr

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """(cost, audit) by a plain table over (turn, roles so far), insertions unrolled."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(k, state, inserted):
        ways = []
        if k == len(turns) and state in ("", "a"):
            ways.append((0, ""))
        if inserted < 2:
            c, s = best(k, "a" if state == "u" else "u", inserted + 1)
            ways.append((c + 2, "I" + s))
        if k < len(turns):
            initial, must, cut = turns[k]
            c, s = best(k + 1, state, 0)
            ways.append((c + 3, "D" + s))
            if not must:
                if initial in step[state]:
                    c, s = best(k + 1, step[state][initial], 0)
                    ways.append((c + cut, "K" + s))
                c, s = best(k + 1, "a" if state == "u" else "u", 0)
                ways.append((c + 2 + cut, "R" + s))
        return min(ways, default=(10**9, ""))

    for k in range(len(turns), 0, -1):  # keeps the recursion shallow
        for state in step:
            best(k, state, 0)
    return best(0, "", 0)


def expected(rows, damage=True):
    white = "\x20\t\n\x0b\x0c\r"
    by, ids = defaultdict(list), set()
    for c, t, role, text in rows:
        ids.add(c)
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[c] += [(t is not None, t or 0, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    found = {}
    for c in ids:
        got = by[c]
        order = {x: i for i, x in enumerate(sorted({x[:3] for x in got}))}
        got = sorted(got, key=lambda x: order[x[:3]])
        seen, turns, blank, repeated, cut = set(), [], 0, 0, 0
        for _, _, role, text in got:
            bare = text.rstrip(white)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            blank, repeated, cut = blank + (fault == "b"), repeated + (fault == "d"), cut + (fault == "t")
            turns.append((role[:1], fault in ("b", "d"), fault == "t"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        named = [x[1] for x in got if x[0]]
        gaps = max(named) - min(named) + 1 - len(set(named)) if named else 0
        cost, audit = cheapest(tuple(turns))
        lines, i, state = [], 0, ""
        for e in audit:
            if e == "I":
                state = "a" if state == "u" else "u"
                lines.append(("assistant" if state == "a" else "user") + ":")
                continue
            _, _, role, text = got[i]
            i += 1
            if e == "R":
                state = "a" if state == "u" else "u"
                role = "assistant" if state == "a" else "user"
            elif e == "K":
                state = role[:1]
            if e != "D":
                lines.append(f"{role}:{text}")
        found[c] = (gaps, blank, repeated, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_agenda_finds_the_least_audit():
    rnd = random.Random(2)
    for _ in range(400):
        turns = [(rnd.choice("suax"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randrange(9))]
        items = cr.span_items(turns, (0,))
        assert min((items[g][0], items[g][2]) for g in cr.GOALS if g in items) == cheapest(tuple(turns))
        cuts = sorted(rnd.randrange(len(turns) + 1) for _ in range(3))
        spans = [cr.span_items(turns[a:b], cr.STATES) for a, b in zip([0, *cuts], [*cuts, len(turns)])]
        items = cr.joined_items(spans, cr.GOALS)
        assert min((items[g][0], items[g][2]) for g in cr.GOALS if g in items) == cheapest(tuple(turns))


def test_op13_equals_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert result(cr.repair_digests(cr.damaged(table))) == expected(rows)


def odd_rows():
    rnd = random.Random(11)
    rows = [(None, None, None, None), (None, 3, "user", "Null conversation."), (None, None, "user", "No turn."), (1, None, "user", None),
            (2, 5, "", "no role."), (2, 6, "tool", "unknown role."), (3, 0, "user", ""), (3, 0, "user", ""), (4, 9, "system", "Only a system."),
            (5, 1, "user", "Twice."), (5, 1, "user", "Twice."), (5, 2, "user", "Twice."), (5, 3, "assistant", "x" * 200_000 + "\t\n")]
    for c in range(10, 60):
        rows += [(c, rnd.choice([None, *range(8)]), rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["Hi.", "Yes!", "cut", " ", "Why? ", f"{k}."]))
                 for k in range(rnd.randrange(1, 9))]
    rows += [(7, k, rnd.choice(["user", "assistant"]), rnd.choice(["Hi.", "cut", "", f"{k}."])) for k in range(700)]  # a hot conversation
    return rows


@pytest.mark.parametrize("parts", [2, 23])
def test_odd_conversations(spark, parts):
    rows = odd_rows()
    # One text per conversation and turn: the order within a turn is by hash.
    rows = list({r[:2]: r for r in rows}.values()) + [(5, 1, "user", "Twice."), (3, 0, "user", "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wide = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], f"{SCHEMA}, c string, t long, piece string")
        assert result(cr.repair_digests(wide)) == expected(rows, damage=False)
        assert result(cr.repair_digests(cr.damaged(wide))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dropped_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair_digests(cr.damaged(empty)).collect() == []
    gone = spark.createDataFrame([(8, 1, "user", "Hi.", 0)], f"{SCHEMA}, copies int")
    assert result(cr.repair_digests(gone)) == {8: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    got = cr.repair(spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Cut")], SCHEMA)).first()
    assert (got.cost, got.audit, got.repaired) == (3, "RK", "user:Hello.\nassistant:Cut")
