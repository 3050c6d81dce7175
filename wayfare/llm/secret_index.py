"""Secret scans over a trigram inverted index, in DataFrame operations only.

From each rule's regex follows a Boolean query: alternatives, each a set of trigrams that every match
of that alternative holds. The index keeps, for each trigram that any rule asks for, the documents
whose lower-cased text has it. Intersecting the postings gives each rule's candidates, and only they
run the regex. A rule without mandatory trigrams runs on all documents.

A match's place is the summed length, in code points, of the gaps and matches before it. Null and
empty texts have no spans; a null id is an id like others; rows that repeat an id share its
candidates and are each verified on their own text; other columns are ignored.
"""

from __future__ import annotations

import re._constants as code
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import let

_MANY = 256  # alternatives to follow before a part of a regex counts as unknown


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if group ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The base rules, in the order of their spans.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer) [A-Za-z0-9._~+/-]+", 0, 31),
)
RULES = BASE_RULES + MORE_RULES

Query = frozenset[frozenset[str]]
_ANY: Query = frozenset([frozenset()])


def _either(queries: list[Query]) -> Query:
    found = frozenset().union(*queries)
    return frozenset(q for q in found if not any(o < q for o in found))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > _MANY:
        return a if _ANY != a else b
    return _either([frozenset(x | y for x in a for y in b)])


def _of_strings(strings: set[str]) -> Query:
    return _either([frozenset([frozenset(s[i:i + 3] for i in range(len(s) - 2))]) for s in strings])


def trigram_query(regex: str) -> Query:
    """Alternatives of lower-case trigrams, one of which the lower-cased text of any match holds in full."""
    def strings(item) -> set[str] | None:
        """All strings that the item can match, if they are few."""
        op, value = item
        if op is code.LITERAL:
            return {chr(value).lower()}
        if op is code.IN and all(k is code.LITERAL for k, _ in value) and len(value) <= 4:
            return {chr(c).lower() for _, c in value}
        if op is code.SUBPATTERN:
            return sequence(value[3])
        if op is code.BRANCH:
            parts = [sequence(p) for p in value[1]]
            return None if None in parts else set().union(*parts)
        if op in (code.MAX_REPEAT, code.MIN_REPEAT) and value[1] <= 5:
            once = sequence(value[2])
            if once is None:
                return None
            found, power = set(), {""}
            for n in range(int(value[1]) + 1):
                found |= power if n >= value[0] else set()
                power = {a + b for a in power for b in once}
                if len(power) > _MANY:
                    return None
            return found
        return None

    def sequence(items) -> set[str] | None:
        found = {""}
        for item in items:
            more = strings(item)
            if more is None or len(found) * len(more) > _MANY:
                return None
            found = {a + b for a in found for b in more}
        return found

    def query(items) -> Query:
        need, run = _ANY, {""}
        for item in items:
            more = strings(item)
            if more is not None and len(run) * len(more) <= _MANY:
                run = {a + b for a in run for b in more}
                continue
            need, run = _both(need, _of_strings(run)), {""}
            op, value = item
            if op is code.SUBPATTERN:
                need = _both(need, query(value[3]))
            elif op is code.BRANCH:
                need = _both(need, _either([query(p) for p in value[1]]))
            elif op in (code.MAX_REPEAT, code.MIN_REPEAT) and value[0] > 0:
                need = _both(need, query(value[2]))
            elif more is not None:
                run = more
        return _both(need, _of_strings(run))

    return query(parser.parse(regex))


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings ``gram`` (place in ``grams``), ``doc_id`` of the trigrams that the rules ask for."""
    low = F.lower(F.col("text"))
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return docs.select("doc_id", F.explode(held).alias("gram"))


def candidates(postings: DataFrame, grams: list[str], queries: dict[str, Query]) -> DataFrame:
    """``doc_id`` and a flag ``may_<kind>`` for each query, of documents that meet one at least."""
    words = range((len(grams) + 61) // 62)
    masks = [
        F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.expr("shiftleft(1L, gram % 62)")).otherwise(F.lit(0)))
        .alias(f"m{w}") for w in words
    ]
    met = postings.groupBy("doc_id").agg(*masks)

    def holds(query: Query) -> Column:
        clauses = []
        for clause in query:
            need = [sum(1 << (grams.index(g) % 62) for g in clause if grams.index(g) // 62 == w) for w in words]
            clauses.append(reduce(lambda a, b: a & b, [
                F.col(f"m{w}").bitwiseAND(F.lit(n)) == F.lit(n) for w, n in zip(words, need)]))
        return reduce(lambda a, b: a | b, clauses)

    flags = [holds(q).alias(f"may_{kind}") for kind, q in queries.items()]
    met = met.select("doc_id", *flags)
    return met.where(reduce(lambda a, b: a | b, [F.col(f"may_{kind}") for kind in queries]))


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of one rule as structs ``at, place, till, kind``: leftmost, not overlapping, failing ones dropped."""
    # \G ties each search to the end of the last match, so the text is read once.
    whole = F.lit(rf"\G([\s\S]*?)({rule.regex})")
    found = F.arrays_zip(
        F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"),
        F.regexp_extract_all(text, whole, F.lit(2)).alias("hit"),
        F.regexp_extract_all(text, whole, F.lit(2 + rule.group)).alias("part"))

    def placed(rows):
        begin = F.struct(F.lit(0).alias("end"), F.expr(
            "cast(array() as array<struct<at:int,place:int,till:int,kind:string>>)").alias("spans"))

        def step(state, row):
            at = state["end"] + F.length(row["gap"])
            till = at + F.length(row["hit"])
            span = F.struct(at.alias("at"), F.lit(place).alias("place"), till.alias("till"), F.lit(rule.kind).alias("kind"))
            more = F.when(F.length(row["part"]) >= rule.least, F.concat(state["spans"], F.array(span)))
            return F.struct(till.alias("end"), more.otherwise(state["spans"]).alias("spans"))

        return F.aggregate(rows, begin, step, lambda state: state["spans"])

    return let(found, placed)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """Spans of every row of ``docs(doc_id, text)``; the first ``base`` rules are counted and digested."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if frozenset() not in q}
    text = F.coalesce(F.col("text"), F.lit(""))
    if indexed:
        grams = sorted({g for q in indexed.values() for clause in q for g in clause})
        postings = materialise(build_index(rows, grams), "trigram-postings")
        met = candidates(postings, grams, indexed).withColumnRenamed("doc_id", "id")
        rows = rows.join(met, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    none = F.expr("cast(array() as array<struct<at:int,place:int,till:int,kind:string>>)")
    parts = []
    for place, rule in enumerate(rules):
        # A run of a class too short to count costs a search, so all rows are first asked for a long one.
        may = F.coalesce(F.col(f"may_{rule.kind}"), F.lit(False)) if rule.kind in indexed else text.rlike(_long(rule))
        parts.append(F.when(may, rule_spans(text, rule, place)).otherwise(none))
    spans = F.sort_array(F.concat(*parts))

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["till"].cast("string"))), ",")

    def digest(s: Column) -> Column:
        own = F.filter(s, lambda x: x["place"] < base)
        counts = [F.size(F.filter(s, _is(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])]
        return F.struct(*counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(s).alias("spans"))

    return rows.select("doc_id", let(spans, digest).alias("found")).select("doc_id", "found.*")


def _is(place: int):
    return lambda x: x["place"] == place


def _long(rule: Rule) -> str:
    """A regex that any text with a match of ``rule`` has a match of: the rule, with its least length where it is one class."""
    items = list(parser.parse(rule.regex))
    one_class = len(items) == 1 and items[0][0] is code.MAX_REPEAT and rule.regex.endswith("]+")
    return f"{rule.regex[:-1]}{{{rule.least}}}" if one_class and rule.least else rule.regex
