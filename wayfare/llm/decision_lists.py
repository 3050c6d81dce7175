"""Quality rules as a learnt decision list, in DataFrame operations only.

Sequential covering: a rule grows by the threshold condition with the largest FOIL gain for low
quality until it covers no good document or gains nothing; it is then cut back to the prefix of
conditions that does best on rows kept apart for pruning; the rows it covers leave, and the next rule
grows on the rest. Each step is one aggregate over a written table of statistics: thresholds are
quantiles, so a step brings ``statistics * bins`` counts to the driver, whatever the table's size. The
list becomes one ``CASE WHEN`` column.

Labelled rows are at most ``sample`` (lowest hash of the id); held-out ids are never learnt from.
Null texts count as empty; nulls among ids or labels are not learnt from; an empty or one-sided set
of labels gives the list that keeps all. Repeated rows are each judged; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import held_out
from .text_statistics import base_statistics, count_of, line_numbers

#: Statistics that conditions may test.
STATISTICS = (
    "n_words", "mean_word", "symbol_rate", "bar_rate", "shout_rate", "upper_rate", "repeat_rate",
    "distinct_rate", "dup_line_rate",
)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts and :data:`STATISTICS` of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), base_statistics(text).alias("w"),
        line_numbers(text).alias("l"), count_of(text, "#*$%&|<>").alias("n_symbols"),
        count_of(text, "|").alias("bars"), count_of(text, "!").alias("shouts"),
        count_of(text, "A-Z").alias("uppers"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "bars", "shouts", "uppers")
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    return base.select(
        "*", per_word("word_chars").alias("mean_word"), per_word("n_symbols").alias("symbol_rate"),
        per_word("bars").alias("bar_rate"), per_word("shouts").alias("shout_rate"),
        per_char("uppers").alias("upper_rate"), per_word("n_repeat_words").alias("repeat_rate"),
        per_word("n_distinct_words").alias("distinct_rate"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_rate"),
    )


def labelled_ids(labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` ids with their label, none of them held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


@dataclass
class DecisionList:
    """Ordered rules; each is a list of ``(statistic, at_least, threshold)``. A covered text is rejected."""

    rules: list[list[tuple[str, bool, float]]] = field(default_factory=list)

    def column(self) -> Column:
        """True (keep) unless a rule covers the row."""
        verdict = None
        for rule in self.rules:
            met = _all(rule)
            verdict = F.when(met, F.lit(False)) if verdict is None else verdict.when(met, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def text(self) -> str:
        return "\n".join(
            "reject if " + " and ".join(f"{s} {'>=' if up else '<'} {t:.6g}" for s, up, t in rule)
            for rule in self.rules) + "\nelse keep"


def _all(conditions: list[tuple[str, bool, float]]) -> Column:
    met = F.lit(True)
    for name, up, threshold in conditions:
        met = met & ((F.col(name) >= threshold) if up else (F.col(name) < threshold))
    return met


def _place(statistic: str, cuts: list[float]) -> Column:
    """How many of ``cuts`` are at most the statistic."""
    value = F.col(statistic)
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= value))


def learn(
    examples: DataFrame, statistics: tuple[str, ...] = STATISTICS, bins: int = 40, max_rules: int = 10,
    max_conditions: int = 4, least: int = 8, precision: float = 0.8,
) -> DecisionList:
    """Sequential covering over ``examples`` (statistics, ``label`` 0 or 1, ``prune`` boolean).

    ``least``: low-quality rows that a rule must cover; ``precision``: least share of low quality
    among the pruning rows that it covers.
    """
    found = DecisionList()
    cuts = examples.select(*[
        F.expr(f"array_sort(array_distinct(percentile_approx({s}, array({', '.join(f'{k / bins:.6f}' for k in range(1, bins))}), 10000)))").alias(s)
        for s in statistics
    ]).first()
    cuts = {s: [float(c) for c in cuts[s] or []] for s in statistics}
    # A statistic's place among its thresholds, as a literal array: the same rows are cut alike each time.
    place = F.array(*[F.struct(F.lit(s).alias("s"), _place(s, cuts[s]).alias("k")) for s in statistics])
    left = examples.withColumn("places", place)
    for _ in range(max_rules):
        rule, growing = [], left.where("not prune")
        totals = growing.agg(F.sum(1 - F.col("label")), F.sum("label")).first()
        bad, good = int(totals[0] or 0), int(totals[1] or 0)
        while len(rule) < max_conditions and bad >= least and good:
            counts = (
                growing.where(_all(rule)).select("label", F.explode("places").alias("p"))
                .groupBy("p.s", "p.k").agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good"))
                .collect()
            )
            best = _best(counts, cuts, bad, good, least)
            if best is None:
                break
            rule.append(best[1:4])
            bad, good = best[4:]
        if not rule:
            break
        rule = _pruned(left.where("prune"), rule)
        kept = left.where("prune").where(_all(rule)).agg(F.sum(1 - F.col("label")), F.count("*")).first()
        if not kept[1] or (kept[0] or 0) < precision * kept[1]:
            break
        found.rules.append(rule)
        left = left.where(~_all(rule))
    return found


def _best(counts, cuts, bad: int, good: int, least: int):
    """The condition of largest FOIL gain, with what it covers; ties by statistic, side, threshold."""
    before = math.log2(bad / (bad + good))
    best = None
    for s in sorted(cuts):
        at = {r["k"]: (int(r["bad"]), int(r["good"])) for r in counts if r["s"] == s}
        b = g = 0
        for k in range(len(cuts[s])):
            b, g = b + at.get(k, (0, 0))[0], g + at.get(k, (0, 0))[1]
            for up, x, y in ((False, b, g), (True, bad - b, good - g)):
                if x < least or y == good:
                    continue
                gain = x * (math.log2(x / (x + y)) - before)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, s, up, cuts[s][k], x, y)
    return best


def _pruned(rows: DataFrame, rule: list) -> list:
    """The shortest prefix of the rule with the best ``(bad - good) / (bad + good)`` on ``rows``."""
    worth = rows.agg(*[
        (F.sum(F.when(_all(rule[:n]), 1 - 2 * F.col("label"))) / F.sum(F.when(_all(rule[:n]), 1))).alias(f"w{n}")
        for n in range(1, len(rule) + 1)
    ]).first()
    scores = [(w if w is not None else -2.0, -n) for n, w in enumerate(worth, 1)]
    return rule[:-max(scores)[1]]


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DecisionList:
    """The decision list of a corpus: statistics of the labelled sample, written once, then :func:`learn`."""
    chosen = materialise(labelled_ids(labels, sample), "rule-labels")
    ids = F.broadcast(chosen)  # at most ``sample`` rows
    examples = with_statistics(docs.select("doc_id", "text").join(ids.select("doc_id"), "doc_id", "left_semi"))
    examples = examples.join(ids, "doc_id").withColumn("prune", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0)
    return learn(materialise(examples.select(*STATISTICS, "label", "prune"), "rule-examples"))


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every row of ``docs``."""
    n, repeat = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < 50) | (100 * repeat > 50 * n)
    return with_statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(rules.column()).alias("kept"))
