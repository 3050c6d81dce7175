"""Ids of white-space-delimited words, each new word encoded once by the tokenizers library.

The vocabulary files of this kind drop white space and never merge across it, so a text's ids are
its words' ids in order. Words are UTF-8 bytes; the six ASCII white-space bytes cut them.
"""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

from .common import LOWER, per_worker

#: The byte alphabet of byte-level vocabularies; printable bytes stand for themselves.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _OWN]
_ALPHABET = {b: b for b in _OWN} | {b: 256 + i for i, b in enumerate(_REST)}

#: Where lowering ASCII first could change the result: special strings, or characters that compose.
_CAREFUL = re.compile(rb"<\||[\xcc-\xff]")


class WordIds:
    """Bounded table word -> ids as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, room: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.room, self.known = room, {}

    def words(self, raw: bytes) -> list[bytes]:
        return (raw if _CAREFUL.search(raw) else raw.translate(LOWER)).split()

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _fresh(self, word: bytes) -> bytes:
        bare = word.rstrip(b".,")
        if bare and len(bare) < len(word):
            text = bare.decode()
            if text[-1].isalpha():  # letters and marks never share a token
                return self._known(bare) + self._known(word[len(bare):])
        elif not _CAREFUL.search(word):
            text = word.decode()
            low = text if text.islower() else "".join(c.lower() for c in text)
            if text.isalpha() and low.isalpha() and not _CAREFUL.search(coded := low.encode()):
                return self._pack(t.id for t in self.model.tokenize(coded.decode("latin-1").translate(_ALPHABET)))
        return self._pack(self.library(word.decode()))

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _known(self, word: bytes) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.known[word] = self._fresh(word)
        return ids

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed."""
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            pass
        if len(known) > self.room:
            known.clear()
        return list(map(self._known, words))


def word_ids(path: str) -> WordIds:
    """The worker's table for ``path``."""
    return per_worker(f"words {path}", lambda: WordIds(path))
