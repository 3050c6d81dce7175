"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash over 16 bytes cuts a text wherever its top bits are zero, so equal passages fall into
equal chunks at any offset and in any document. A worker encodes a chunk once and keeps, in a
bounded table, the ids of its inner words and the open words at its ends. Where two chunks meet, the
ids on both sides of the cut are wrong if a word spans it; the join is re-encoded in a window that
grows over whole chunks, if need be, until white space bounds it on both sides. There the vocabulary
restarts, so what stands left and right agrees with an encoding of the whole text exactly.

Null and empty texts have no ids; repeated rows are each encoded; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, arrow, map_batches, per_worker
from .word_ids import _CAREFUL, WordIds, word_ids

_SPACE = frozenset(b" \t\n\x0b\x0c\r")
_BASE = 0x9E3779B97F4A7C15
_TYPES = {"doc_id": pa.int64(), "ids": pa.binary(), "decoded": pa.string()}
_DIGEST = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def cuts(data: bytes, bits: int = 7, least: int = 32) -> list[int]:
    """Ends of content-defined chunks: about ``2 ** bits`` bytes, ``least`` at least, whole characters."""
    if len(data) <= least:
        return [len(data)] if data else []
    raw = np.frombuffer(data, np.uint8)
    h, power = raw.astype(np.uint64), _BASE
    for reach in (1, 2, 4, 8):
        h[reach:] = h[reach:] + h[:-reach] * np.uint64(power)
        power = power * power % (1 << 64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_BASE)
    cut = (h >> np.uint64(64 - bits)) == 0
    ends = np.flatnonzero(cut[:-1] & ((raw[1:] & 0xC0) != 0x80)) + 1
    found, last = [], 0
    for end in ends.tolist():
        if end - last >= least:
            found.append(end)
            last = end
    if last < len(data):
        found.append(len(data))
    return found


class ChunkEncoder:
    """Encodes texts by chunks; ``room`` bounds the chunks that stay known."""

    def __init__(self, words: WordIds, room: int = 100_000):
        self.words, self.room, self.known = words, room, {}
        self.encoded = self.reused = self.repaired = 0
        if words.tokenizer.decoder is not None:
            raise ValueError("only vocabularies whose decoder joins tokens by a space")
        size = words.tokenizer.get_vocab_size()
        self.tokens = [(words.tokenizer.id_to_token(i) or "").encode() for i in range(size)]

    def _chunk(self, data: bytes) -> tuple[bytes | None, bytes, bytes]:
        """Ids of the inner words (None: no white space inside), open word at the start and at the end."""
        known = self.known.get(data)
        if known is not None:
            self.reused += 1
            return known
        self.encoded += 1
        parts = data.split()
        first, last = data[0] not in _SPACE, data[-1] not in _SPACE
        if len(parts) == 1 and first and last:
            made = (None, data, b"")
        else:
            head = parts.pop(0) if first else b""
            tail = parts.pop() if last else b""
            made = (b"".join(self.words(parts)), head, tail)
        if len(self.known) >= self.room:
            self.known.clear()
        self.known[data] = made
        return made

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, packed like those of :class:`WordIds`."""
        raw = text.encode()
        if not _CAREFUL.search(raw):
            raw = raw.translate(LOWER)
        out, open_word, begin = [], b"", 0
        for end in cuts(raw):
            inner, head, tail = self._chunk(raw[begin:end])
            begin = end
            joined = open_word + head
            if inner is None:  # no white space yet: the window grows over this chunk
                open_word = joined
                continue
            if joined:
                self.repaired += bool(open_word)
                out += self.words([joined])
            out.append(inner)
            open_word = tail
        if open_word:
            out += self.words([open_word])
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, ids))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) ``, decoded`` for every row of ``docs``."""
    def make():
        encoder = per_worker(f"chunks {path}", lambda: ChunkEncoder(word_ids(path)))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [
                np.frombuffer(encoder.encode(t or ""), f"<u{encoder.words.width}").astype("<u4")
                for t in batch.column(1).to_pylist()
            ]
            return arrow(
                _TYPES, batch.column(0), [i.tobytes() for i in ids],
                [encoder.decode(i.tolist()).decode() for i in ids],
            )

        return step

    return map_batches(_rows(docs), make, "doc_id long, ids binary, decoded string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """Token count and digests of ids and decoded text, without moving either out of the task."""
    def make():
        encoder = per_worker(f"chunks {path}", lambda: ChunkEncoder(word_ids(path)))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, coded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(encoder.encode(text or ""), f"<u{encoder.words.width}").astype("<u4")
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids.tolist())).hexdigest())
            return arrow(_DIGEST, batch.column(0), n, coded, decoded)

        return step

    return map_batches(_rows(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
