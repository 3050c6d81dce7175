"""Token counts, chunked BPE and binary records against the libraries themselves."""

import base64
import hashlib
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

from wayfare.llm import binary_records as br  # noqa: E402
from wayfare.llm.chunk_bpe import ChunkEncoder, cuts, encode_documents, encoding_digests  # noqa: E402
from wayfare.llm.common import map_batches, per_worker  # noqa: E402
from wayfare.llm.token_counts import Counter as TokenCounter  # noqa: E402
from wayfare.llm.token_counts import count_tokens  # noqa: E402
from wayfare.llm.word_ids import WordIds  # noqa: E402
from wayfare.session import new_path  # noqa: E402

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


def strange(n=1500):
    rnd = random.Random(4)
    signs = "abcdeth the▁ \nin. éü1<0x>-='s"
    made = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(120))) for _ in range(n)]
    return made + [
        " ", "  a  b", "▁" * 9, "aaaa" * 400, "-" * 99, "\n" * 20, "12345" * 50, "日本語テキスト" * 30, "<0x41></s>",
        base64.b64encode(rnd.randbytes(6000)).decode(), "İstanbul ǅ ẞ", "H̱ K Σίσυφος", "a\xa0b c\x1cd\x85e",
        "don't they're I'LL 'S's", "q,. w.,x ..., a.b", "x²½ Ⅷ ٣",
    ]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(WORDS)


def test_merging_equals_sentencepiece():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = strange()
    assert TokenCounter(PIECES)(texts) == [len(x) for x in sp.encode(texts)]
    assert TokenCounter(PIECES, room=10)(texts) == [len(x) for x in sp.encode(texts)]


def test_token_counts(docs, rows, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for i, t in rows:
        n = len(sp.encode(t or ""))
        want[i, len((t or "").encode()), n, n > 4096] += 1
    assert Counter(map(tuple, count_tokens(docs, PIECES).collect())) == want
    assert count_tokens(none, PIECES).collect() == []


def test_word_table_equals_library(library):
    table = WordIds(WORDS, room=50)
    for text, want in zip(strange(), library.encode_batch(strange(), add_special_tokens=False)):
        assert np.frombuffer(b"".join(table(table.words(text.encode()))), np.uint16).tolist() == want.ids, text


def test_chunks_share_and_repair(library):
    rnd = random.Random(1)
    encoder = ChunkEncoder(WordIds(WORDS), room=1000)
    passage = " ".join("w" + str(rnd.randrange(10**6)) for _ in range(300))
    first = encoder.encode(passage)
    assert encoder.encode("other start " + passage) and encoder.reused > 5 and encoder.repaired > 0
    assert np.frombuffer(first, np.uint16).tolist() == library.encode(passage, add_special_tokens=False).ids
    for text in (*strange(), "no" * 5000, passage.replace(" ", "_")):
        ids = np.frombuffer(encoder.encode(text), np.uint16).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)
    data = passage.encode()
    ends = cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and min(np.diff([0, *ends[:-1]])) >= 32


def test_encode_documents(docs, rows, none, library):
    want, digests = Counter(), Counter()
    for (i, t), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        ids, text = np.array(e.ids, "<u4").tobytes(), library.decode(e.ids, skip_special_tokens=False)
        want[i, ids, text] += 1
        digests[i, len(e.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r[0], bytes(r[1]), r[2]) for r in encode_documents(docs, WORDS).collect()) == want
    assert Counter(map(tuple, encoding_digests(docs, WORDS).collect())) == digests
    assert encode_documents(none, WORDS).collect() == []


def test_records(spark, docs, rows, none, library):
    place = new_path(spark, "records")
    index = br.write_records(docs, WORDS, place, 2)
    texts = spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string")
    place_of = {r.text: r.h for r in texts.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place_of[r[1]]))
    want, start = Counter(), 0
    for (i, t), e in zip(ordered, library.encode_batch([t or "" for _, t in ordered], add_special_tokens=False)):
        ids = np.array(e.ids + [2], "<u4").tobytes()
        want[i, start, len(ids) // 4, ids] += 1
        start += len(ids) // 4
    assert Counter((r[0], r[1], r[2], bytes(r[3])) for r in br.read_records(spark, place).collect()) == want
    crc = Counter((i, s, n, zlib.crc32(b)) for i, s, n, b in want.elements())
    assert Counter(map(tuple, br.record_digests(spark, place).collect())) == crc
    shuffled = index.orderBy(F.xxhash64("offset", "file")).limit(40)
    got = Counter((r[0], bytes(r[2])) for r in br.fetch_records(shuffled, place).collect())
    assert got.total() == 40 and not got - Counter((i, b) for i, _, _, b in want.elements())
    empty = new_path(spark, "records")
    br.write_records(none, WORDS, empty, 2)
    assert br.read_records(spark, empty).collect() == []


def test_rows_without_an_id_spread_over_files(spark, odd, library):
    many = spark.range(4_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"),
        F.lit("x").alias("h"), F.lit(1).alias("part"), F.lit("y").alias("file"), F.lit(2).alias("offset"))
    place = new_path(spark, "records")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = br.write_records(many, WORDS, place, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.select("file").distinct().count() >= 4
    assert br.read_records(spark, place).count() == 4_000
    wide, plain = new_path(spark, "records"), new_path(spark, "records")
    br.write_records(odd.withColumn("h", odd.key).withColumn("file", odd.key), WORDS, wide, 2)
    br.write_records(odd.select("doc_id", "text"), WORDS, plain, 2)
    assert Counter(map(tuple, br.record_digests(spark, wide).collect())) == Counter(map(tuple, br.record_digests(spark, plain).collect()))


def test_damaged_record_is_noticed():
    import io

    data = bytearray(br.record(7, b"\1\0\2\0", 2))
    found = br.read_record(io.BytesIO(bytes(data)))
    assert found[0] == 7 and found[1].tolist() == [1, 2]
    for at in (0, 9, len(data) - 6):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            br.read_record(io.BytesIO(bytes(broken)))


def test_workers_keep_only_what_a_task_asks_for(spark):
    def asks(*names):
        def make():
            for name in names:
                per_worker(name, object)

            def step(batch):
                return pa.RecordBatch.from_arrays([pa.array([",".join(sorted(sys.modules["wayfare_worker"].kept))])], ["kept"])

            return step

        return map_batches(spark.range(0, 1, 1, 1), make, "kept string").first()[0]

    assert [asks("a", "b"), asks("b"), asks(), asks("c")] == ["a,b", "b", "", "c"]
