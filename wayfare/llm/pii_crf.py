"""Personal data: exact base patterns, and a linear-chain CRF over word shapes for what they miss.

Tokens are runs of non-space characters. A token may be inside a span if it holds a digit, ``@`` or a
bracketed ``at``/``dot``, is a spelled-out ``at``/``dot`` of an address, or stands beside such a word
or beside marks alone (``-``, ``/``); every other token is outside (a hard constraint of the model), so
a chain falls apart into runs of neighbours, and decoding these runs is exact. Features of a token are
its whole shape (letters, digits and marks, repeats collapsed), lengths, digit groups, marks, the
shapes around it and the word before the run; states are outside and begin/inside of each kind. The
model is trained on a small labelled table of marked sentences (:mod:`pii_examples`) by its exact
likelihood (forward-backward, Adam), and decoded by Viterbi in numpy, all runs of one length at once.

The CRF adds its spans, trimmed of outer punctuation, where they overlap no base span; base spans
stay as they are, and the ``n_`` columns and ``base_sha256`` describe base spans.

Null and empty texts have no spans; repeated rows are each searched; without a model no span is
added; other columns are ignored. A very long text is searched whole, as is a very long token.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, map_batches
from .pii_examples import examples

#: The kinds, in the order of their spans.
KINDS = ("email", "ip", "card", "phone")
STATES = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# Each starts where a run starts: a match takes its whole run, so none begins inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(
    r"[0-9@]|[(\[{<]\x20?(?i:at|dot)\x20?[)\]}>]|(?<!\S)(?i:dot)(?!\S)"
    r"|(?<!\S)(?i:at)(?=\x20{1,2}\S*[A-Za-z]\.[A-Za-z])")
_LINK = re.compile(r"[(\[{<]?(at|dot)[)\]}>]?", re.IGNORECASE)
_INNER = re.compile(r"[(\[{<](?:at|dot)[)\]}>]", re.IGNORECASE)
_MARKS = re.compile(r"[-–/.@()\[\]]{1,2}")
_NUMBER = re.compile("[0-9]+")
_REST = re.compile(r"\S*")
_OUTER_LEFT, _OUTER_RIGHT = "([{<\"'“”‘’", ".,;:!?)]}>\"'“”‘’"
_PAIRS = dict(zip("([{<", ")]}>"))

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by start and kind."""
    found, before = [], 0
    for m in _DOMAIN.finditer(text):
        segment = text[before:m.start()]
        local = len(segment) - len(segment.rstrip(_LOCAL))
        if local:
            found.append((m.start() - local, 0, m.end()))
            before = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _before(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The token one or two spaces before ``at`` that starts at ``floor`` or later."""
    end = at
    while end > floor and at - end < 2 and text[end - 1] == " ":
        end -= 1
    begin = end
    while begin > floor and not text[begin - 1].isspace():
        begin -= 1
    return (begin, end) if begin < end < at else None


def _after(text: str, at: int) -> tuple[int, int] | None:
    """The token one or two spaces after ``at``."""
    begin = at
    while begin - at < 2 and text[begin:begin + 1] == " ":
        begin += 1
    end = _REST.match(text, begin).end()
    return (begin, end) if at < begin < end else None


def _joins(text: str, a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether one of two neighbours is a spelled-out mark or marks alone."""
    return any(y - x <= 5 and (_LINK.fullmatch(text, x, y) or _MARKS.fullmatch(text, x, y)) for x, y in (a, b))


def runs_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that may be inside; tokens as start and end."""
    runs, floor = [], 0
    while (m := _MARK.search(text, floor)) is not None:
        begin = m.start()
        while begin > floor and not text[begin - 1].isspace():
            begin -= 1
        left, right = [], [(begin, _REST.match(text, m.start()).end())]
        while (near := _before(text, (left or right[:1])[-1][0], floor)) and _joins(text, near, (left or right[:1])[-1]):
            left.append(near)
        while (near := _after(text, right[-1][1])) and _joins(text, right[-1], near):
            right.append(near)
        piece = left[::-1] + right
        gap = text[floor:piece[0][0]] if piece[0][0] - floor <= 2 else "x"
        if runs and not gap.strip(" "):
            runs[-1] += piece
        else:
            runs.append(piece)
        floor = piece[-1][1]
    return runs


def shape(token: str) -> str:
    """Letters as ``a``/``A``, digits as ``9``, other characters as they are; repeats collapsed."""
    out, last = [], ""
    for c in token:
        k = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if k != last:
            out.append(k)
            last = k
    return "".join(out)


def _trimmed(token: str) -> tuple[int, int]:
    """Start and end of a token without outer punctuation; a bracket that is closed inside stays."""
    a, b = 0, len(token)
    closed = {left: token.rfind(right, 0, b - 1) for left, right in _PAIRS.items()}
    while a < b and token[a] in _OUTER_LEFT and closed.get(token[a], -1) <= a:
        a += 1
    opened = {right: token.find(left, a) for left, right in _PAIRS.items()}
    while b > a and token[b - 1] in _OUTER_RIGHT and opened.get(token[b - 1], -1) < 0:
        b -= 1
    return a, b


def _link(token: str) -> str:
    found = _LINK.fullmatch(token) if len(token) <= 5 else None
    return found[1].lower() if found else "in" if _INNER.search(token) else ""


def features(text: str, run: list[tuple[int, int]]) -> list[list[str]]:
    """The features of each token of a run."""
    tokens = [text[a:b] for a, b in run]
    bare = [t[slice(*_trimmed(t))] for t in tokens]
    shapes = [shape(t) for t in bare]
    links = [_link(t) for t in tokens]
    numbers = [_NUMBER.findall(t) for t in bare]
    near = _before(text, run[0][0], 0)
    word = text[slice(*near)].strip(_OUTER_LEFT + _OUTER_RIGHT).lower() if near else ""
    whole, chain = sum(len(n) for part in numbers for n in part), "".join(sorted({k for k in links if k}))
    found = []
    for i, t in enumerate(bare):
        digits = sum(map(len, numbers[i]))
        small = len(numbers[i]) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers[i])
        found.append([
            "bias", f"s={shapes[i]}", f"d={min(digits, 20)}", f"l={min(len(t), 24)}",
            f"g={'-'.join(str(len(n)) for n in numbers[i]) if len(numbers[i]) < 6 else 'many'}",
            f"at={'@' in t}", f"dots={min(t.count('.'), 4)}", f"colons={min(t.count(':'), 3)}", f"plus={t[:1] == '+'}",
            f"luhn={12 <= digits <= 19 and _luhn(''.join(numbers[i]))}", f"small={small}",
            f"p={shapes[i - 1] if i else ''}", f"n={shapes[i + 1] if i + 1 < len(bare) else ''}",
            f"link={links[i]}", f"pl={links[i - 1] if i else ''}", f"nl={links[i + 1] if i + 1 < len(bare) else ''}",
            f"run={min(len(bare), 6)}", f"rd={min(whole, 24)}", f"rl={chain}/{shapes[i]}", f"w={word}", f"w={word}/{i == 0}",
        ])
    return found


def labels_of(run: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """States of a run's tokens by the spans that cover them."""
    states, last = [], None
    for a, b in run:
        hit = next((s for s in spans if s[0] < b and s[2] > a), None)
        states.append(0 if hit is None else 1 + 2 * hit[1] + (hit == last))
        last = hit
    return states


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties: inside a kind follows only begin or inside of that kind, and starts nothing."""
    n = len(STATES)
    step, first = np.zeros((n, n)), np.zeros(n)
    for j, name in enumerate(STATES):
        if name[0] == "I":
            first[j] = -1e4
            step[[i for i in range(n) if STATES[i][2:] != name[2:]], j] = -1e4
    return step, first


@dataclass
class Crf:
    names: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def scores(self, rows: list[list[list[str]]]) -> np.ndarray:
        """Emission scores of runs of one length: run, token, state."""
        blank, get = len(self.names), self.names.get
        width = len(rows[0][0])
        index = np.array([[[get(f, blank) for f in token] for token in run] for run in rows]).reshape(len(rows), -1, width)
        return np.vstack([self.emit, np.zeros(len(STATES))])[index].sum(axis=2)

    def decode(self, rows: list[list[list[str]]]) -> np.ndarray:
        """The best states of runs of one length (Viterbi)."""
        emit = self.scores(rows)
        best, back = emit[:, 0] + self.first, []
        for t in range(1, emit.shape[1]):
            via = best[:, :, None] + self.step
            back.append(via.argmax(axis=1))
            best = via.max(axis=1) + emit[:, t]
        path = [best.argmax(axis=1)]
        for pointer in reversed(back):
            path.append(pointer[np.arange(len(rows)), path[-1]])
        return np.stack(path[::-1], axis=1)


def train(table: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Crf | None:
    """A CRF of labelled runs, by gradient steps on the penalised likelihood; None without runs."""
    if not table:
        return None
    names: dict[str, int] = {}
    for run, _ in table:
        for token in run:
            for f in token:
                names.setdefault(f, len(names))
    n = len(STATES)
    step_ok, first_ok = _allowed()
    groups: dict[int, list] = {}
    for run, states in table:
        groups.setdefault(len(run), []).append(([[names[f] for f in token] for token in run], states))
    data = [(np.array([r for r, _ in g]), np.array([s for _, s in g])) for _, g in sorted(groups.items())]
    emit, step, first = np.zeros((len(names), n)), np.zeros((n, n)), np.zeros(n)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (emit, step, first)]
    for turn in range(1, rounds + 1):
        grads = [decay * len(table) * p for p in (emit, step, first)]
        for index, states in data:
            rows, length = states.shape
            score = emit[index].sum(axis=2)
            move, start = step + step_ok, first + first_ok
            ahead = [score[:, 0] + start]
            for t in range(1, length):
                ahead.append(_logsum(ahead[-1][:, :, None] + move, 1) + score[:, t])
            behind = [np.zeros((rows, n))]
            for t in range(length - 1, 0, -1):
                behind.append(_logsum(move + (score[:, t] + behind[-1])[:, None, :], 2))
            behind.reverse()
            whole = _logsum(ahead[-1], 1)
            for t in range(length):
                belief = np.exp(ahead[t] + behind[t] - whole[:, None])
                belief[np.arange(rows), states[:, t]] -= 1
                np.add.at(grads[0], index[:, t], belief[:, None, :])
                if t == 0:
                    grads[2] += belief.sum(axis=0)
                else:
                    joint = np.exp(ahead[t - 1][:, :, None] + move + (score[:, t] + behind[t])[:, None, :] - whole[:, None, None])
                    grads[1] += joint.sum(axis=0)
                    np.add.at(grads[1], (states[:, t - 1], states[:, t]), -1)
        for p, g, (m, v) in zip((emit, step, first), grads, moments):
            g = g / len(table)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)
    return Crf(names, emit, step + step_ok, first + first_ok)


def added_spans(texts: list[str], base: list[list[Span]], model: Crf | None) -> list[list[Span]]:
    """The CRF's spans of each text that overlap no base span."""
    found: list[list[Span]] = [[] for _ in texts]
    if model is None:
        return found
    by_length: dict[int, list] = {}
    for i, text in enumerate(texts):
        for run in runs_of(text):
            by_length.setdefault(len(run), []).append((i, run))
    for length, group in by_length.items():
        size = max(1, 20_000 // length)
        for begin in range(0, len(group), size):
            part = group[begin:begin + size]
            states = model.decode([features(texts[i], run) for i, run in part])
            for (i, run), path in zip(part, states.tolist()):
                found[i] += _read(texts[i], run, path, base[i])
    return [sorted(f) for f in found]


def _read(text: str, run: list[tuple[int, int]], path: list[int], base: list[Span]) -> list[Span]:
    spans, t = [], 0
    while t < len(path):
        if not path[t]:
            t += 1
            continue
        kind, last = (path[t] - 1) // 2, t
        while last + 1 < len(path) and path[last + 1] == 2 + 2 * kind:
            last += 1
        a, b = _trimmed(text[run[t][0]:run[last][1]])
        begin, end = run[t][0] + a, run[t][0] + b
        if begin < end and not any(s[0] < end and s[2] > begin for s in base):
            spans.append((begin, kind, end))
        t = last + 1
    return spans


_FOUND = {"doc_id": pa.int64(), **{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(), "spans": pa.string(), "n_added": pa.int64()}


def labelled_runs(held_out: bool = False) -> list[tuple[list[list[str]], list[int]]]:
    """The runs of the labelled table with their states; held-out sentences only on request."""
    table = []
    for text, marks in examples(held_out):
        spans = [(a, KINDS.index(kind), b) for a, kind, b in marks]
        table += [(features(text, run), labels_of(run, spans)) for run in runs_of(text)]
    return table


def span_quality(model: Crf | None) -> tuple[float, float]:
    """Precision and recall of all spans (base and added) of the held-out sentences, exact bounds and kinds."""
    texts, marks = zip(*examples(True))
    base = [base_spans(t) for t in texts]
    found = {(i, *s) for i, part in enumerate(zip(base, added_spans(list(texts), base, model))) for spans in part for s in spans}
    true = {(i, a, KINDS.index(kind), b) for i, part in enumerate(marks) for a, kind, b in part}
    right = len(found & true)
    return right / max(len(found), 1), right / max(len(true), 1)


def find_personal_data(docs: DataFrame, model: Crf | None) -> DataFrame:
    """Base counts, digest of the base spans and all spans of every row of ``docs(doc_id, text)``."""
    parts = None if model is None else (model.names, model.emit, model.step, model.first)
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # plain values: workers need no import

    def make():
        crf = Crf(*shared.value) if shared.value is not None else None

        def written(spans: list[Span]) -> str:
            return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, crf)
            counts = [[sum(s[1] == k for s in b) for b in base] for k in range(len(KINDS))]
            return arrow(
                _FOUND, batch.column(0), *counts, [hashlib.sha256(written(b).encode()).hexdigest() for b in base],
                [written(sorted(a + b)) for a, b in zip(added, base)], list(map(len, added)))

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_batches(rows, make, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")
