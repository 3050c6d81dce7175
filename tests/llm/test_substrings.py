"""Removal of repeated passages against all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from wayfare.llm import substring_dedup as sd


def expected(rows, window=50):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = np.zeros(len(w) + 1, int)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    gone[k] += 1
                    gone[k + window if k + window < len(w) else len(w)] -= 1
        kept = [x for x, g in zip(w, np.cumsum(gone)) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_matching_statistics():
    rnd = random.Random(4)
    for _ in range(200):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 25))) for _ in range(3)]
        a = sd.Automaton()
        for t in texts:
            a.add(t)
        probe = "".join(rnd.choice("abc") for _ in range(40))
        want = [max(n for n in range(k + 2) if any(probe[k + 1 - n:k + 1] in t for t in texts)) for k in range(40)]
        assert a.matches(probe) == want
        assert len(a.size) <= 2 * sum(map(len, texts)) + 1


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(8)
    base = [b"%d" % rnd.randrange(9) for _ in range(120)]
    texts = [base, base[30:], [b"x"] * 7 + base[5:100] + [b"y"] * 20, [b"z"] * 49, [], [b"q"] * 200]
    of = {}
    owner, key, start, n = sd.anchors(texts)
    for t, k, s, m in zip(owner.tolist(), key.tolist(), start.tolist(), n.tolist()):
        for i in range(s, s + m):
            window = tuple(texts[t][i:i + sd.WINDOW])
            assert len(window) == sd.WINDOW and (t, i) not in of
            of[t, i] = (window, k)
    assert len(of) == sum(max(0, len(t) - 49) for t in texts)
    keys = {}
    for window, k in of.values():
        assert keys.setdefault(window, k) == k


def made(seed):
    """Documents of passages that many share, at other offsets and with other neighbours, and near copies."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    common = [[word() for _ in range(n)] for n in (49, 50, 51, 55, 64, 80, 130, 400)]
    rows = []
    for i in range(160):
        text = []
        for _ in range(rnd.randrange(4)):
            text += [word() for _ in range(rnd.randrange(70))]
            p = rnd.choice(common)
            a = rnd.randrange(max(1, len(p) - 50)) if rnd.random() < 0.4 else 0
            text += p[a:]
        rows.append((rnd.randrange(10_000), " ".join(text)))
    for i, t in rows[:40]:
        w = t.split()
        for _ in range(len(w) // 60):
            w[rnd.randrange(len(w))] = word()
        rows.append((rnd.randrange(10_000), "\n".join(w)))
    rows += rows[:10] + [(None, rows[1][1]), (rows[3][0], rows[5][1])]
    return rows


@pytest.mark.parametrize(("parts", "hot"), [(3, 512), (31, 4)])
def test_shared_passages(spark, monkeypatch, parts, hot):
    rows = made(parts)
    monkeypatch.setattr(sd, "_HOT", hot)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(sd.repeat_digests(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spots string, p long")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected(rows)
    assert sum(r[2] for r in got) > 1000


def test_op11_equals_brute_force(spark, docs, rows):
    assert result(sd.repeat_digests(docs)) == expected(rows)


def test_odd_and_empty(spark, odd, none):
    got = {r.doc_id: r for r in sd.without_repeats(odd).collect()}
    assert got[9_000_001].n_words == 0 and got[9_000_001].kept == ""
    assert got[None].n_removed == 0 and got[9_000_009].n_removed == 0
    assert sd.repeat_digests(none).collect() == []


def test_a_hot_key_over_many_tasks():
    """One key for nearly all rows, cut into tasks and batches at any place."""
    rnd = random.Random(6)
    for _ in range(300):
        rows = sorted({(rnd.choice([1, 5, 5, 5, 9]), rnd.randrange(6), 0, s) for s in range(rnd.randrange(1, 30))})
        cuts = sorted(rnd.randrange(len(rows) + 1) for _ in range(3))
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            reader, at = sd._Reader(), a
            while at < b:
                to = min(b, at + rnd.randrange(1, 6))
                cols = [np.array(c, np.int64) for c in zip(*rows[at:to])]
                out += [r for x in reader.read(*cols, np.ones(to - at, np.int64)) for r in x.to_pylist()]
                at = to
            out += [r for x in reader.close() for r in x.to_pylist()]
        edges = {}
        for r in out:
            if r["kind"] == 3:
                e = edges.setdefault(r["key"], [(r["doc"], r["tkey"], r["start"], r["shard"]), r["first"]])
                e[0], e[1] = min(e[0], (r["doc"], r["tkey"], r["start"], r["shard"])), max(e[1], r["first"])
        got = []
        for r in out:
            if r["kind"] < 2:
                got.append((r["kind"], r["key"], r["doc"], r["start"], r["first"], r["shard"]))
            elif r["kind"] == 2 and edges[r["key"]][1] > edges[r["key"]][0][0]:
                first, shard = edges[r["key"]][0][0], edges[r["key"]][0][3]
                got.append((int(r["doc"] > first), r["key"], r["doc"], r["start"], first, shard))
        want = []
        for key in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == key]
            if mine[-1][1] > mine[0][1]:
                shard = int(sd._shard(np.array([0]), np.array([mine[0][3]]))[0])
                want += [(int(d > mine[0][1]), key, d, s, mine[0][1], shard) for _, d, _, s in mine]
        assert sorted(got) == sorted(want)
