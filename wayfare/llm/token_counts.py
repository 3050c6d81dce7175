"""Token counts by merging ragged numpy arrays in step with the merge ranks.

A text becomes pre-tokens: a run of spaces with what follows it, cut also around line feeds, since
no piece of the vocabulary crosses these bounds (checked when the vocabulary is read). New
pre-tokens of a batch lie side by side in one flat array with offsets. In each round every
pre-token's lowest-rank pair is found by one segmented minimum and all pre-tokens merge theirs at
once, until none has a pair left. Surviving symbols are the tokens; a symbol outside the vocabulary
counts its UTF-8 bytes (byte fallback).

Exactness: the library always merges the best pair, leftmost first. Occurrences of a pre-token's
best pair merge together from the left up to the first merge that brings in a pair at least as good.

Nulls and empty texts have no tokens; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import arrow, map_batches, per_worker

_BLANK = "▁"
_NONE = np.int64(1 << 40)
_PIECES = re.compile(r"\n| *[^ \n]+| +")
_TYPES = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()}


class Vocabulary:
    """Pieces as integers; the pair table is a sorted array of ``left * size + right`` keys."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  B\nÉＡ "
        if sp.normalize(probe) != (_BLANK + probe).replace(" ", _BLANK):
            raise ValueError("only vocabularies that leave texts as they are but for spaces")
        usable = [
            i for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        ]
        pieces = [sp.id_to_piece(i) for i in usable]
        if any(re.search(f"[^{_BLANK}]{_BLANK}|\n", p) for p in pieces):
            raise ValueError("a piece crosses a pre-token bound")
        self.size = len(pieces) + 1
        self.symbol = {p: k for k, p in enumerate(pieces) if len(p) == 1}
        at = {p: k for k, p in enumerate(pieces)}
        # Equal scores share a rank: between them the leftmost pair wins.
        score = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in usable}, reverse=True))}
        keys, made, rank = [], [], []
        for p, k in at.items():
            for cut in range(1, len(p)):
                left, right = at.get(p[:cut]), at.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    made.append(k)
                    rank.append(score[sp.get_score(usable[k])])
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        self.rank = np.array(rank, dtype=np.int64)[order]
        self.unknown = self.size - 1
        # Neighbouring characters that no piece holds can never come together.
        near = {(p[i], p[i + 1]) for p in pieces for i in range(len(p) - 1)}
        near = [self.symbol[a] * self.size + self.symbol[b] for a, b in near if a in self.symbol and b in self.symbol]
        self.near = np.unique(np.array([*near, -1], dtype=np.int64))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; ``_NONE`` where the vocabulary has no such piece."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), self.made[at]

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token (spaces written as in the vocabulary)."""
        n = len(pretokens)
        sizes = np.fromiter(map(len, pretokens), np.int64, n)
        get, unknown = self.symbol.get, self.unknown
        flat = "".join(pretokens)
        symbols = np.fromiter((get(c, unknown) for c in flat), np.int64, len(flat))
        owner = np.repeat(np.arange(n), sizes)
        # Unknown characters never merge; their bytes are counted once and for all.
        lost = np.flatnonzero(symbols == unknown)
        extra = np.zeros(n, np.int64)
        if len(lost):
            np.add.at(extra, owner[lost], [len(flat[i].encode()) - 1 for i in lost.tolist()])
        key = symbols[:-1] * self.size + symbols[1:]
        at = np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)
        apart = (self.near[at] != key) | (owner[:-1] != owner[1:])
        parent, owner = owner[np.append(True, apart)] if len(owner) else owner, np.append(0, np.cumsum(apart))[:len(owner)]
        counts = np.zeros(len(parent), np.int64)
        while len(symbols):
            same = owner[:-1] == owner[1:]
            rank, made = self.pairs(symbols[:-1], symbols[1:])
            rank = np.append(np.where(same, rank, _NONE), _NONE)
            made = np.append(made, 0)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(owner)))
            best = np.minimum.reduceat(rank, starts)
            over = best == _NONE
            if over.any():
                counts[owner[starts[over]]] = lengths[over]
                keep = np.repeat(~over, lengths)
                symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
                lengths, best = lengths[~over], best[~over]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == np.repeat(best, lengths))
            # Of overlapping pairs the left one stays: every second one of each run of neighbours.
            run = np.append(True, (np.diff(chosen) != 1) | (owner[chosen[1:]] != owner[chosen[:-1]]))
            first = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            after = symbols.copy()
            after[chosen] = made[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            # Stop a pre-token at its first merge whose new neighbours pair at least as well.
            new_symbols, new_owner = after[keep], owner[keep]
            place = np.cumsum(keep)[chosen] - 1
            limit = rank[chosen]
            better = np.zeros(len(chosen), bool)
            inner = place > 0
            left, _ = self.pairs(new_symbols[place[inner] - 1], new_symbols[place[inner]])
            better[inner] = (left <= limit[inner]) & (new_owner[place[inner] - 1] == new_owner[place[inner]])
            inner = place < len(new_symbols) - 1
            right, _ = self.pairs(new_symbols[place[inner]], new_symbols[place[inner] + 1])
            better[inner] |= (right <= limit[inner]) & (new_owner[place[inner]] == new_owner[place[inner] + 1])
            if better.any():
                who = owner[chosen]
                begin = np.append(True, who[1:] != who[:-1])
                before = np.cumsum(better) - better
                base = np.maximum.accumulate(np.where(begin, before, 0))
                chosen = chosen[before == base]
                after = symbols.copy()
                after[chosen] = made[chosen]
                keep = np.ones(len(symbols), bool)
                keep[chosen + 1] = False
                new_symbols, new_owner = after[keep], owner[keep]
            symbols, owner = new_symbols, new_owner
        np.add.at(extra, parent, counts)
        return extra


class Counter:
    """Counts the tokens of texts; keeps the counts of up to ``room`` pre-tokens."""

    def __init__(self, path: str, room: int = 500_000):
        self.vocabulary, self.room = Vocabulary(path), room
        # Keyed by what follows one space (or by a line feed and what follows it) ...
        self.plain: dict[str, int] = {}
        # ... and, for texts with runs of spaces, by the whole pre-token.
        self.spaced: dict[str, int] = {}

    def _learn(self, known: dict[str, int], texts: list[list[str]], written) -> None:
        seen = set().union(*texts)
        new = seen - known.keys()
        if len(known) + len(new) > self.room:
            known.clear()
            new = seen
        new = list(new)
        for begin in range(0, len(new), 20_000):
            part = new[begin:begin + 20_000]
            known.update(zip(part, self.vocabulary.count([written(k) for k in part]).tolist()))

    def __call__(self, texts: list[str | None]) -> list[int]:
        plain, spaced = {}, {}
        for i, text in enumerate(texts):
            if not text:
                continue
            text = text.replace(_BLANK, " ")
            if "  " in text or " \n" in text or text[0] == " ":
                spaced[i] = _PIECES.findall(" " + text)
            else:
                plain[i] = text.replace("\n", " \n").split(" ")
        counts = [0] * len(texts)
        self._learn(self.plain, list(plain.values()), lambda k: k if k[:1] == "\n" else _BLANK + k)
        self._learn(self.spaced, list(spaced.values()), lambda k: k.replace(" ", _BLANK))
        for known, split in ((self.plain, plain), (self.spaced, spaced)):
            for i, keys in split.items():
                counts[i] = sum(map(known.__getitem__, keys))
        return counts


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs(doc_id, text)``.

    ``path`` is a sentencepiece model without text normalisation; begin and end are not counted.
    """
    def make():
        counter = per_worker(f"counts {path}", lambda: Counter(path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            counts = counter(texts)
            sizes = [len(t.encode()) if t else 0 for t in texts]
            return arrow(_TYPES, batch.column(0), sizes, counts, [c > limit for c in counts])

        return step

    columns = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return map_batches(columns, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
