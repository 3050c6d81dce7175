"""Quality classifier: a sparse ensemble of rules taken from trees, compiled to Spark columns.

A small forest of shallow trees is fitted over text statistics of a bounded labelled sample; every
path from a root to a node is a conjunction of thresholds, that is a rule. A logistic model with a
lasso penalty over the rules' 0/1 columns keeps a few of them; the kept rules and weights become one
column expression, so scoring a corpus is one scan without a shuffle.

Sample: at most ``sample`` labelled rows, those with the lowest hash of their id, none held out.
Inputs of a score are statistics of the text alone. A null text counts as empty; ids or labels that
are null are not learnt from; without rows of both labels every score is the smoothed share of label
1 (0.5 without labels). Repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import held_out, total
from .decision_lists import labelled_ids
from .text_statistics import count_of, line_numbers, word_statistics

STATISTICS = (
    "n_words", "mean_word", "distinct_rate", "symbol_rate", "bar_rate", "shout_rate", "upper_rate",
    "stop_rate", "dup_line_rate",
)

Rule = tuple[tuple[str, bool, float], ...]


def with_statistics(docs: DataFrame, *kept: Column) -> DataFrame:
    """``doc_id``, :data:`STATISTICS` of each text and the ``kept`` columns."""
    names = ["doc_id", *[f"kept{i}" for i in range(len(kept))]]
    kept = [c.alias(n) for c, n in zip(kept, names[1:])]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), word_statistics(text).alias("w"), line_numbers(text).alias("l"),
        count_of(text, "#*$%&<>").alias("symbols"), count_of(text, "|").alias("bars"),
        count_of(text, "!").alias("shouts"), count_of(text, "A-Z").alias("uppers"),
        count_of(text, ".").alias("stops"), *kept,
    ).select(*names, "w.*", "l.*", "symbols", "bars", "shouts", "uppers", "stops")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return base.select(
        *names, F.col("n_words").cast("double").alias("n_words"), share("word_chars", "n_words").alias("mean_word"),
        share("n_distinct_words", "n_words").alias("distinct_rate"), share("symbols", "n_words").alias("symbol_rate"),
        share("bars", "n_words").alias("bar_rate"), share("shouts", "n_words").alias("shout_rate"),
        share("uppers", "word_chars").alias("upper_rate"), share("stops", "n_words").alias("stop_rate"),
        share("n_dup_lines", "n_lines").alias("dup_line_rate"),
    )


@dataclass
class RuleEnsemble:
    """``intercept`` plus the weights of the rules that hold, through the logistic function."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        margin = total([F.when(_met(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules])
        return 1 / (1 + F.exp(-(margin + F.lit(self.intercept))))

    def text(self) -> str:
        return "\n".join([f"{self.intercept:+.4f}"] + [
            f"{w:+.4f} if " + " and ".join(f"{s} {'>' if up else '<='} {t:.6g}" for s, up, t in rule)
            for rule, w in self.rules])


def _met(rule: Rule) -> Column:
    met = F.lit(True)
    for name, up, threshold in rule:
        met = met & ((F.col(name) > threshold) if up else (F.col(name) <= threshold))
    return met


def tree_rules(forest, names: tuple[str, ...]) -> list[Rule]:
    """The paths of all trees as rules, each once, in a fixed order.

    A path keeps the tightest threshold for each statistic and side.
    """
    found: set[Rule] = set()

    def walk(node, path: dict) -> None:
        if path:
            found.add(tuple((n, up, t) for (n, up), t in sorted(path.items())))
        if node.getClass().getSimpleName() != "InternalNode":
            return
        split = node.split()
        name, threshold = names[split.featureIndex()], float(split.threshold())
        low, high = path.get((name, False), math.inf), path.get((name, True), -math.inf)
        walk(node.leftChild(), path | {(name, False): min(low, threshold)})
        walk(node.rightChild(), path | {(name, True): max(high, threshold)})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), {})
    return sorted(found)


def fit(examples: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """The ensemble of ``examples`` (:data:`STATISTICS` and ``label`` 0 or 1)."""
    n, good = examples.agg(F.count("*"), F.sum("label")).first()
    good = good or 0
    if good in (0, n):
        share = (good + 1) / (n + 2)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(examples)
    forest = RandomForestClassifier(
        labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt",
        subsamplingRate=0.7, maxBins=64, minInstancesPerNode=5,
    ).fit(rows.select("features", "label"))
    rules = tree_rules(forest, STATISTICS)
    if not rules:
        return RuleEnsemble(math.log(good / (n - good)), [])
    met = examples.select("label", F.array(*[_met(r).cast("double") for r in rules]).alias("met"))
    met = materialise(met, "rule-columns")
    model = LogisticRegression(
        labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False,
    ).fit(met.select("label", array_to_vector("met").alias("features")).coalesce(4))
    weights = model.coefficients.toArray().tolist()
    return RuleEnsemble(float(model.intercept), [(r, w) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> RuleEnsemble:
    """The ensemble of a corpus: statistics of the labelled sample, written once, then :func:`fit`."""
    chosen = materialise(labelled_ids(labels, sample), "quality-labels")
    ids = F.broadcast(chosen)  # at most ``sample`` rows
    examples = with_statistics(docs.select("doc_id", "text").join(ids.select("doc_id"), "doc_id", "left_semi"))
    examples = examples.join(ids, "doc_id").select(*STATISTICS, F.col("label").cast("double").alias("label"))
    return fit(materialise(examples, "quality-examples"))


def score_documents(docs: DataFrame, model: RuleEnsemble, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    scored = with_statistics(docs).select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleEnsemble, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, all columns as they were."""
    scored = with_statistics(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return scored.where(model.score() >= cut).select("kept0.*")
