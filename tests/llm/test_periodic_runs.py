"""Periodic runs against all stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wayfare.llm import periodic_runs as pr


def brute(words, least=24, copies=3):
    n, found = len(words), {}
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, copies * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def altered(i, words):
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def expected(i, text):
    words = altered(i, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (i, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_of_random_words(letters):
    rnd = random.Random(letters)
    for turn in range(60):
        texts = []
        for _ in range(4):
            t = []
            while len(t) < rnd.randrange(1, 160):
                part = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 12))]
                t += (part * rnd.randrange(1, 7))[:rnd.randrange(1, 60)]
            texts.append(t)
        words = np.array([w for t in texts for w in t])
        owner = np.repeat(np.arange(4), [len(t) for t in texts])
        for least in (24, 6):
            want, at = [], 0
            for t in texts:
                want += [(at + s, n, q) for s, n, q in brute(t, least)]
                at += len(t)
            assert [tuple(r) for r in pr.find_runs(words, owner, least).tolist()] == want


def test_splits_meet_each_pair_once():
    rnd = random.Random(1)
    lcp = np.array([0] + [rnd.randrange(4) for _ in range(40)])
    seen = {}
    for k, a, b in zip(*(x.tolist() for x in pr._splits(lcp))):
        for x in range(a, k):
            for y in range(k, b + 1):
                assert (x, y) not in seen
                seen[x, y] = lcp[k]
    for x in range(41):
        for y in range(x + 1, 41):
            assert seen.get((x, y), 0) == lcp[x + 1:y + 1].min()


def test_op12_equals_brute_force(spark, docs, rows):
    got = sorted(map(tuple, pr.run_digests(docs).collect()), key=str)
    short = [(i, t) for i, t in rows if len((t or "").split()) < 3000]
    want = sorted((expected(i, t) for i, t in short), key=str)
    ids = {i for i, _ in short}
    assert [r for r in got if r[0] in ids] == want
    assert len(got) == len(rows)
    assert sum(r[1] for r in got) > 10


def test_long_and_odd_texts(spark, odd, none):
    got = {r.doc_id: r for r in pr.repeated_runs(odd).collect()}
    long = got[9_000_009]  # 30,000 times one word, then 2,000 times another
    assert [tuple(r) for r in long.runs] == [(0, 30_000, 1), (30_001, 2_000, 1)]
    assert (long.start, long.length, long.period, long.exponent_milli) == (0, 30_000, 1, 30_000_000)
    assert long.collapsed == "long " + "x" * 50_000 + " é1.2.3.4"
    assert got[9_000_001].n_runs == 0 and got[9_000_001].collapsed == "" and got[9_000_001].start is None
    assert pr.run_digests(none).collect() == []


def test_ties_take_the_first(spark):
    text = "a b c " * 10 + "x " + "d e f " * 10
    r = pr.repeated_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_runs, r.start, r.length, r.period, r.collapsed) == (2, 0, 30, 3, "a b c x d e f")
