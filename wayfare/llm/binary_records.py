"""Token ids as length-delimited binary records, with a separate offset index.

A record is framed as: length of the payload (unsigned 64-bit), masked checksum of these eight
bytes, payload, masked checksum of the payload; all little-endian. The payload holds a flag whether
there is a document id, the id (signed 64-bit), the width of an id in bytes and the ids. The
checksum is CRC-32, rotated by 15 bits and shifted by a constant, so that a checksum stored inside
data does not look like its own.

Documents are dealt by range of (``doc_id``, hash of the text) and sorted, so files in order of their
part hold ids in ascending ``doc_id`` order (null first; equal ids by hash of the text, then by text),
and rows of one id, the null id too, spread over tasks as far as their texts differ. Each task writes a
file under a name of its own and hands over the offsets of its records; the index is an ordinary
Parquet table, so only files of tasks that succeeded are in it, whatever was lost or repeated before.
Files are written as a stream: memory holds one batch of texts.

A null or empty text is a record of the end id alone; repeated rows are a record each; an empty table
gives an empty index and no file; other columns are ignored. A very long text is one record.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, map_batches
from .word_ids import word_ids

_LENGTH, _CHECK, _HEAD = "<Q", "<I", "<?qB"
_MASK = 0xA282EAD8
_INDEX = {
    "part": pa.int64(), "file": pa.string(), "doc_id": pa.int64(), "offset": pa.int64(),
    "n_tokens": pa.int64(),
}
_READ = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
_DIGEST = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return struct.pack(_CHECK, (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF)


def frame(payload: bytes) -> bytes:
    length = struct.pack(_LENGTH, len(payload))
    return b"".join((length, masked(length), payload, masked(payload)))


def record(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return frame(struct.pack(_HEAD, doc_id is not None, doc_id or 0, width) + ids)


def read_record(stream) -> tuple[int | None, np.ndarray] | None:
    """The next record of a binary stream: document id and ids; None at the end."""
    length = stream.read(8)
    if not length:
        return None
    if stream.read(4) != masked(length):
        raise ValueError("a record's length does not match its checksum")
    payload = stream.read(struct.unpack(_LENGTH, length)[0])
    if stream.read(4) != masked(payload):
        raise ValueError("a record does not match its checksum")
    has_id, doc_id, width = struct.unpack_from(_HEAD, payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_HEAD))


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the plain path of a folder given as path or URI."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Encode and write ``docs(doc_id, text)``; returns the index, also kept under ``folder/index``."""
    def make():
        words = word_ids(tokenizer)
        end = end_id.to_bytes(words.width, "little")
        fs, base = opened(folder)
        fs.create_dir(f"{base}/records", recursive=True)
        return words, end, fs, base

    def write(batches):
        words, end, fs, base = make()
        part, name = TaskContext.get().partitionId(), None
        offset = 0
        stream = None
        for batch in batches:
            if stream is None:
                name = f"records/part-{part:06d}-{uuid.uuid4().hex}"
                stream = fs.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
            offsets, sizes = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = b"".join(words(words.words((text or "").encode()))) + end
                data = record(doc_id, ids, words.width)
                stream.write(data)
                offsets.append(offset)
                sizes.append(len(ids) // words.width)
                offset += len(data)
            n = len(offsets)
            yield arrow(_INDEX, [part] * n, [name] * n, batch.column(0), offsets, sizes)
        if stream is not None:
            stream.close()

    ordered = (
        docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(cast(text as string)) h")
        .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    )
    index = ordered.mapInArrow(write, "part long, file string, doc_id long, offset long, n_tokens long")
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, with the ids before it; spread so that each file is a task's work."""
    index = spark.read.parquet(f"{folder}/index")
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.repartition(max(1, index.select("file").distinct().count()), "file")


def _scan(spark: SparkSession, folder: str, types: dict, schema: str, last) -> DataFrame:
    def make():
        fs, base = opened(folder)

        def read(batch):
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with fs.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as stream:
                    while (found := read_record(stream)) is not None:
                        doc_id, ids = found
                        rows.append((doc_id, start, len(ids), last(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 256:
                            yield arrow(types, *zip(*rows))
                            rows = []
                if rows:
                    yield arrow(types, *zip(*rows))

        return read

    def run(batches):
        read = make()
        for batch in batches:
            yield from read(batch)

    return _files(spark, folder).mapInArrow(run, schema)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record in file order: ``doc_id, start, n_tokens, ids`` (unsigned 32-bit), checksums verified."""
    return _scan(spark, folder, _READ, "doc_id long, start long, n_tokens long, ids binary", lambda b: b)


def record_digests(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`read_records`, with the CRC-32 of the ids in place of the ids."""
    return _scan(
        spark, folder, _DIGEST, "doc_id long, start long, n_tokens long, ids_crc32 long", zlib.crc32)


def fetch_records(wanted: DataFrame, folder: str) -> DataFrame:
    """Records in any order: ``wanted`` holds rows ``file, offset`` of the index, e.g. shuffled."""
    def make():
        fs, base = opened(folder)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, at, stream = [], None, None
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != at:
                    at, stream = name, fs.open_input_file(f"{base}/{name}")
                stream.seek(offset)
                doc_id, ids = read_record(stream)
                rows.append((doc_id, len(ids), ids.astype("<u4").tobytes()))
            types = {k: _READ[k] for k in ("doc_id", "n_tokens", "ids")}
            return arrow(types, *zip(*rows)) if rows else None

        return step

    return map_batches(wanted.select("file", "offset"), make, "doc_id long, n_tokens long, ids binary")
