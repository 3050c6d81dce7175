"""Quality classifier and decision list: exact statistics, held-out accuracy, odd tables."""

import re
import zlib
from collections import Counter

import pytest

from wayfare.llm import decision_lists as dl
from wayfare.llm import rule_ensemble as ens

WORDS = r"[^ \x09-\x0d]+"


@pytest.fixture(scope="module")
def larger(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_base_statistics(docs, rows, none):
    want = Counter()
    for i, t in rows:
        w, lines = re.findall(WORDS, t or ""), [x for x in (t or "").split("\n") if re.search(WORDS, x)]
        times = Counter(zip(w, w[1:], w[2:]))
        covered = {k for a in range(len(w) - 2) if times[tuple(w[a:a + 3])] > 1 for k in (a, a + 1, a + 2)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed] += 1
    rules = dl.DecisionList([[("symbol_rate", True, 0.4)], [("distinct_rate", False, 0.2), ("n_words", True, 60.0)]])
    got = dl.apply_rules(docs, rules).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert dl.apply_rules(none, rules).collect() == []


def held_out_accuracy(rows, labels, verdict):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return sum(verdict(r) == truth[r.doc_id] for r in held) / len(held)


def test_decision_list(larger):
    docs, labels = larger
    rules = dl.learn_from(docs, labels)
    assert rules.rules and "reject if" in rules.text()
    rows = dl.with_statistics(docs).select("doc_id", rules.column().alias("kept")).collect()
    assert held_out_accuracy(rows, labels, lambda r: int(r.kept)) > 0.9
    assert dl.learn_from(docs, labels).rules == rules.rules


def test_rule_ensemble(larger, odd):
    docs, labels = larger
    model = ens.learn_from(docs, labels)
    rows = ens.score_documents(docs, model).collect()
    assert model.rules and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert held_out_accuracy(rows, labels, lambda r: r.predicted) > 0.9
    assert len(ens.score_documents(odd, model).collect()) == odd.count()
    kept = ens.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in ens.score_documents(odd, model).collect())


def test_without_labels(docs, labels, none):
    rules = dl.learn_from(docs, labels.limit(0))
    assert rules.rules == [] and all(r.kept != r.base_failed for r in dl.apply_rules(docs, rules).collect())
    assert {r.score for r in ens.score_documents(docs, ens.learn_from(docs, labels.limit(0))).collect()} == {0.5}
    assert ens.score_documents(none, ens.RuleEnsemble(0.0, [])).collect() == []
    one_side = ens.learn_from(docs, labels.where("quality = 1"))
    assert one_side.rules == [] and one_side.intercept > 0
