"""Line deduplication, the n-gram join and the pipeline against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import line_dedup as ld
from wayfare.llm import linking
from wayfare.llm import ngram_join as nj
from wayfare.llm.common import components, star_steps
from wayfare.llm.linking import parity_words


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def near_copies(seed, lengths, copies):
    rnd = random.Random(seed)
    found = []
    for n in lengths:
        base = [f"w{rnd.randrange(3000)}" for _ in range(n)]
        for _ in range(copies):
            w = base[:]
            for _ in range(rnd.randrange(2 + n // 30)):
                w[rnd.randrange(n)] = f"x{rnd.randrange(10**6)}"
            found.append(" ".join(w))
    return found


def shingle_sets(rows):
    found = {}
    for i, t in rows:
        w = re.findall(r"[^ \x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        found[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return found


def linked(sets, similarity=0.8):
    by, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for ids in by.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[:k])
    return [(a, b) for (a, b), n in common.items() if None not in (a, b) and n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9]


def test_ngram_join(spark, docs, rows, odd, none):
    rnd = random.Random(8)
    common = " ".join(f"c{i}" for i in range(60))
    more = near_copies(5, (12, 40, 100, 300), 45)
    more += [common + " " + " ".join(f"y{rnd.randrange(10**6)}" for _ in range(rnd.choice([0, 3, 10, 25, 60]))) for _ in range(50)]
    more = list(enumerate([*more, "a b", "A  b", "a b c"], 10**6))
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    sets = shingle_sets(rows + more)
    want = union_find(sets, linked(sets))
    got = nj.ngram_components(table).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(sets[i]), want[i]) for i, _ in rows + more)
    kept = nj.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in odd.collect() if r.doc_id != 9_000_007)
    assert nj.ngram_components(none).collect() == []


@pytest.mark.parametrize("block", [nj._BLOCK_DOCS, 7])
def test_ngram_join_counts_every_link(spark, monkeypatch, block):
    """Links inside a component that the search for components did not need count too."""
    monkeypatch.setattr(nj, "_BLOCK_DOCS", block)
    texts = near_copies(9, (14, 40, 120), 30) + ["a b", "A  b", "a b c"]
    rows = list(enumerate(texts + texts[:5], 100))
    sets = shingle_sets(rows)
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    want = Counter(x for pair in linked({i: s for s, i in first.items()}) for x in pair)
    got = nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: want[first[s]] for i, s in sets.items()}


def test_one_of_each_judges_rows(spark):
    a, b = "five words of one text here", "other words of another text there"
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (None, a), (None, a), (7, near + " x"), (None, near), (8, None), (8, ""), (9, " "), (9, " "),
            (None, "alone without an id, twice"), (None, "alone without an id, twice"), (4, "one row twice is one document"), (4, "one row twice is one document")]
    got = nj.one_of_each(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, key long")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(
        [(3, a), (5, b), (7, near + " x"), (8, None), (8, ""), (9, " "), (9, " "), (None, "alone without an id, twice")]
        + [(4, "one row twice is one document")] * 2)


def test_room_never_rules_out_a_link():
    """Any two sets of similarity 0.8 share a signature that the bounds let through."""
    rnd = np.random.default_rng(7)
    for _ in range(400):
        x = np.unique(rnd.integers(0, 1 << 63, int(rnd.integers(1, 300)), dtype=np.uint64))
        y = x.copy()
        for _ in range(int(rnd.integers(0, 2 + len(x) // 5))):
            y = np.delete(y, rnd.integers(len(y))) if rnd.random() < 0.5 and len(y) > 1 else np.append(y, rnd.integers(0, 1 << 63, dtype=np.uint64))
        y = np.unique(y)
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common):
            continue
        often = np.sort(rnd.choice(x, int(len(x) * rnd.choice([0, 0.5, 0.9, 1])), replace=False))
        (s, r), (t, q) = nj.placed_signatures(x, often, 80), nj.placed_signatures(y, often, 80)
        both, i, j = np.intersect1d(s, t, return_indices=True)
        assert (180 * np.minimum(r[i], q[j]) >= 80 * (len(x) + len(y))).any()
        marks = sum(int(a ^ b).bit_count() if a ^ b >= 0 else int((a ^ b) & (2**64 - 1)).bit_count()
                    for a, b in zip(parity_words(x).tolist(), parity_words(y).tolist()))
        assert marks <= len(x) + len(y) - 2 * common


def test_signatures_never_miss():
    """Any two sets of similarity 0.8 share a signature, whichever tokens count as frequent."""
    rnd = np.random.default_rng(6)
    for turn in range(400):
        n = int(rnd.integers(1, 200))
        x = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        y = x.copy()
        for _ in range(int(rnd.integers(0, 2 + n // 4))):
            y = np.delete(y, rnd.integers(len(y))) if rnd.random() < 0.5 and len(y) > 1 else np.append(y, rnd.integers(0, 1 << 63, dtype=np.uint64))
        y = np.unique(y)
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common):
            continue
        often = np.sort(rnd.choice(x, int(len(x) * rnd.choice([0, 0.5, 1])), replace=False))
        assert np.intersect1d(nj.signatures(x, often, 80), nj.signatures(y, often, 80)).size
        assert nj.fewest_differences(nj.parity_bitmap(x), nj.parity_bitmap(y)) <= len(x) + len(y) - 2 * common


def test_line_dedup(spark, docs, rows, odd, none):
    more = list(enumerate([t + f"\nown line of document number {i * 7919} here" for i, t in enumerate(near_copies(3, (40, 60), 60))] + ["Short line", "Short line"], 10**6))
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    first, spots = {}, []
    for i, t in sorted(rows + more, key=lambda r: (r[0] is not None, r[0] or 0)):
        for no, line in ld.lines_of(t):
            spots.append((i, no))
            first.setdefault(line, (i is not None, i or 0, no))
    lines = list(first)
    sets = {k: frozenset(s[a:a + 8] for a in range(max(1, len(s) - 7))) for k, s in enumerate(lines)}
    groups = union_find(sets, linked(sets))
    stays = {min(first[lines[k]] for k in sets if groups[k] == g)[1:] for g in set(groups.values())}
    stays = {(None if (False, 0, no) in first.values() and i == 0 else i, no) for i, no in stays}
    want = {s for s in spots if s not in stays}
    report = ld.line_report(table).collect()
    got = {(r.doc_id, no) for r in report for no in r.removed}
    assert len(report) == len(rows + more) and len(want ^ got) <= 0.02 * len(want)
    assert all(r.n_removed == len(r.removed) <= r.n_lines for r in report)
    kept = ld.dedup_lines(odd)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == odd.columns and 9_000_007 not in texts and texts[9_000_001] is None and texts[9_000_002] == ""
    assert texts[9_000_005] == "Tie tie tie tie tie tie" and Counter(r.doc_id for r in kept.collect())[9_000_008] == 2
    assert ld.line_report(none).collect() == []


def test_short_lines_outlive_the_long_ones(spark):
    footer = "the footer that every page of the site has"
    table = spark.createDataFrame([(1, footer), (2, f"本页面独有\n{footer}\n \n"), (3, f"{footer}\n\t\n"), (4, f"a b\n\n{footer}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in ld.dedup_lines(table).collect()} == {1: footer, 2: "本页面独有\n \n", 4: "a b\n"}
    assert ld.line_report(table).columns == ["doc_id", "n_lines", "n_removed", "removed"]


def test_lines_take_part_by_characters(spark):
    table = spark.createDataFrame([(1, "Read more\n本站所有内容版权所有\nyes"), (2, "first own line\nRead  more\nyes"), (3, "本站所有内容版权所有\nsecond own line")], "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, r.removed) for r in ld.line_report(table).collect()} == {1: (2, []), 2: (2, [1]), 3: (2, [0])}


def test_rows_without_an_id_keep_their_own_lines(spark):
    footer = "the footer that every page of the site has"
    own = [f"line {'abcdefgh'[k] * 9} belongs to page {k * 7919} alone" for k in range(8)]
    texts = [f"{own[k]}\n{footer}" if k % 2 else f"{footer}\n{own[k]}" for k in range(8)]
    for ids in ([None] * 8, [5] * 8, [None, 5] * 4):
        table = spark.createDataFrame([*zip(ids, texts), (None, footer)], "doc_id long, text string")
        left = [r.text.split("\n") for r in ld.dedup_lines(table).collect()]
        assert Counter(line for t in left for line in t) == Counter([*own, footer]) and len(left) in (8, 9)
        assert sum(r.n_removed for r in ld.line_report(table).collect()) == 8


def test_bands_find_similar_lines():
    rnd, hit, n = random.Random(7), 0, 0
    for _ in range(300):
        a = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(30, 400)))
        b = list(a)
        for _ in range(max(1, len(a) // 90)):
            b[rnd.randrange(len(b))] = "z"
        b = "".join(b)
        s, t = ({x[i:i + 8] for i in range(len(x) - 7)} for x in (a, b))
        if len(s & t) >= 0.8 * len(s | t):
            n += 1
            keys = ld.bands([a, b])
            hit += bool((keys[0] == keys[1]).any())
    assert n > 50 and hit >= 0.96 * n
    assert (ld.bands(["é", "é"])[0] == ld.bands(["é"])[0]).all()


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        assert name == "bpe_encoding" or docs.columns == columns
        docs = docs.transform(lambda d: spark.createDataFrame(d.collect(), d.schema))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "ngram_jaccard_join":
            texts = [(r.doc_id, r.text) for r in before.collect()]
            sets = shingle_sets(texts)
            assert ids == set(union_find(sets, linked(sets)).values())
        if name == "bpe_encoding":
            assert ids == {r.doc_id for r in before.collect()}
    assert Counter(r.doc_id for r in pipeline.run(spark, folder).collect()) == Counter(r.doc_id for r in docs.collect())


def test_shared_signatures_take_one_shuffle(spark, monkeypatch):
    plans, plain = [], linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 3), (3, 4), (3, 4), (4, 5), (4, 6)], "sig long, id long")
    got = linking.shared_only(rows).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (4, 5), (4, 6)]
    assert plans[0].count("Exchange hashpartitioning") == 1


def test_only_texts_of_likely_pairs_are_shuffled(spark, monkeypatch):
    rnd, words = random.Random(8), [f"c{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"])]
    for _ in range(12):
        passage = [f"p{rnd.randrange(10**6)}" for _ in range(12)]
        texts += [" ".join(passage + [f"w{rnd.randrange(10**6)}" for _ in range(25)]) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, asked, link, plain = set(), set(), nj.link, nj._texts

    def linked(rows, *rest, **names):
        met.update(r.id for r in rows.select("id").collect())
        return link(rows, *rest, **names)

    def texts_of(docs, ids):
        asked.update(r.id for r in ids.collect())
        return plain(docs, ids)

    monkeypatch.setattr(nj, "link", linked)
    monkeypatch.setattr(nj, "_texts", texts_of)
    got = {r.doc_id: r.component_id for r in nj.ngram_components(docs).collect()}
    assert got == {i: 0 if i == 1 else i for i in range(len(texts))}
    assert len(met) > 20 and asked <= {0, 1}


def test_lines_of_a_task_get_bands_once(spark):
    text = "a first line of some words\nand a second one\nA first  line of some words"
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").coalesce(1)
    rows = ld.describe(docs).collect()
    assert [len(r.key) for r in rows] == [3] * 6
    assert sum(len(r.fresh) for r in rows) == 2
    assert all(len(r.bands) == ld.BANDS * len(r.fresh) for r in rows)


def test_similar_lines_and_finer_marks():
    rnd = random.Random(3)
    left = ["".join(rnd.choice("abcdef") for _ in range(rnd.randrange(3, 300))) for _ in range(80)]
    right = [s[:len(s) - rnd.randrange(40)] + "x" * rnd.randrange(30) for s in left]

    def runs(s):
        return {s[i:i + 8] for i in range(max(1, len(s) - 7))}

    want = [len(runs(a) & runs(b)) >= 0.8 * len(runs(a) | runs(b)) - 1e-9 for a, b in zip(left, right)]
    assert True in want and False in want
    assert ld.similar(left, right, 0.8).tolist() == want
    a, b = (np.array([rnd.randrange(2**63) for _ in range(300)], np.uint64) for _ in range(2))
    few, many = (int(np.bitwise_count(linking.parity_words(a, w) ^ linking.parity_words(b, w)).sum()) for w in (8, 16))
    assert few < many <= 600


def test_open_signatures_take_one_shuffle(spark, monkeypatch):
    rnd = random.Random(11)
    rows = sorted({(rnd.randrange(25), rnd.randrange(60)) for _ in range(200)})
    edges = sorted({(max(a, b), min(a, b)) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(25)) if a != b})
    plans, plain = [], linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
    stars = star_steps(spark.createDataFrame(edges, "u long, v long"))
    found, n, left = linking._open_rows(spark.createDataFrame([(s, i, 9) for s, i in rows], "sig long, id long, room int"), stars, 1)
    assert plans[-1].count("Exchange hashpartitioning(sig") == 1
    top = union_find(range(60), edges)
    groups = {s: [i for t, i in rows if t == s] for s, _ in rows}
    want = {(s, i, top[i]) for s, ids in groups.items() for i in ids if len({top[k] for k in ids}) > 1}
    got = found.collect()
    assert {(r.sig, r.id, r.comp) for r in got} == want and n == len(got) == len(want)
    assert left == sum(top[a] != top[b] for ids in groups.values() for a in ids for b in ids if a < b)
    for r in got:
        assert r.pivot is None or r.pivot in groups[r.sig] and top[r.pivot] != r.comp
    assert all(any(r.pivot is not None for r in got if r.sig == s) for s in {r.sig for r in got})


def test_pivots_leave_their_signature(spark):
    """No pair is compared twice, and labels are final though the last round finds nothing."""
    rows = [(i, k, 9) for i in range(40) for k in (i, i + 1)] + [(1000, k, 9) for k in (100, 200, 300)]
    rows = linking.shared_only(spark.createDataFrame(rows, "sig long, id long, room int"), pivots=True)
    assert {(r.sig, r.id, r.pivot) for r in rows.collect() if r.later} == {(1000, 200, 100), (1000, 300, 100)}
    marks = spark.range(301).selectExpr("id", "9L n", f"array_repeat(0L, {linking.MARK_WORDS}) marks")
    asked = []

    def verify(pairs):
        asked.append(sorted(map(tuple, pairs.collect())))
        return pairs.where("b = a + 1")

    got = {r.id: (r.component, r.n_links) for r in linking.link(rows, marks, verify, 80).collect()}
    assert got == {k: (0, 1 if k in (0, 40) else 2) for k in range(41)}
    assert asked == [sorted([(i, i + 1) for i in range(40)] + [(100, 200), (100, 300)]), [(200, 300)]]


def test_star_steps_keep_what_is_connected(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 99) for i in range(1, 30)] + [(101, 98), (120, 98)]
    want = union_find({x for e in edges for x in e}, edges)
    for steps in (1, 2, 3):
        left = [(r.u, r.v) for r in star_steps(spark.createDataFrame(edges, "u long, v long"), steps).collect()]
        assert len(left) <= len(edges) and all(u > v for u, v in left)
        assert union_find(want, left) == want


def test_sets_without_copies_are_not_shuffled(spark):
    rows = [(i, bytes([i % 7 if i < 14 else i])) for i in range(60)] + [(3, bytes([3]))]
    full = spark.createDataFrame(rows, "doc_id long, set_hash binary")
    classes = full.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    got = nj._one_row_per_class(full, classes)
    assert sorted(r.doc_id for r in got.collect()) == sorted([*range(7), 3, *range(14, 60)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("LeftSemi")
