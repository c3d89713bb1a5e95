"""Token ids as sorted-string-table files.

A file holds documents in key order: data blocks with prefix-compressed keys, a Bloom filter, a
sparse index with the first key of each block, and a footer of fixed size. One document is found by
the filter, a binary search in the index and one block. All integers are little-endian.

    block   u32 packed size, u32 crc32, zstd of entries: varint shared, varint own, varint value size, key tail, value
    filter  u32 number of probes, bits
    index   zstd of entries: varint key size, key, varint offset
    footer  u64 filter at, u64 filter size, u64 index at, u64 index size, u64 entries, u64 ids, 8 bytes magic

A key is one byte (0: null doc_id, 1: not), doc_id big-endian with its sign bit turned, and the
ordinal among rows with an equal doc_id. A value is the document's ids as unsigned 32-bit integers.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeweave.llm._session import file_system, materialize, texts, work_dir
from tomeweave.llm._text import col, raw_bytes, sliced
from tomeweave.llm._tokens import WordEncoder

MAGIC = b"TWSST001"
FOOTER = struct.Struct("<6Q8s")
BLOCK_BYTES, FILE_BYTES = 64 << 10, 256 << 20
BITS_PER_KEY, PROBES = 10, 7


def encode_key(doc_id: int | None, ordinal: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, ((doc_id or 0) + (1 << 63)) & ((1 << 64) - 1), ordinal)


def decode_key(key: bytes) -> tuple[int | None, int]:
    known, raw, ordinal = struct.unpack(">BQI", key)
    return (raw - (1 << 63) if known else None), ordinal


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, (h >> 64) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class TableWriter:
    """Writes one file to an open binary stream; keys must ascend."""

    def __init__(self, stream, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.stream, self.block_bytes = stream, block_bytes
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.at = self.ids = 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self.block = bytearray()
        self.last = b""

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        if not self.block:
            self.index.append(_varint(len(key)) + key + _varint(self.at))
            self.last = b""
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.keys.append(key)
        self.last = key
        self.ids += len(value) // 4
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = self.pack(bytes(self.block))
            self._put(struct.pack("<II", len(packed), zlib.crc32(packed)) + packed)
            self.block = bytearray()

    def finish(self) -> None:
        self._flush()
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        held = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                held[p >> 3] |= 1 << (p & 7)
        filter_at = self.at
        self._put(struct.pack("<I", PROBES) + held)
        index_at = self.at
        self._put(self.pack(b"".join(self.index)))
        self._put(FOOTER.pack(filter_at, index_at - filter_at, index_at, self.at - index_at, len(self.keys), self.ids, MAGIC))


class TableReader:
    """Reads one file from a seekable binary stream of known size."""

    def __init__(self, stream, size: int):
        import zstandard

        self.unpack = zstandard.ZstdDecompressor().decompress
        self.stream = stream
        *places, self.entries, self.ids, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        self.filter = self._at(places[0], places[1])[4:]
        self.first: list[bytes] = []
        self.offsets: list[int] = []
        index, at = self.unpack(self._at(places[2], places[3]), max_output_size=1 << 31) if places[3] else b"", 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.first.append(index[at : at + n])
            offset, at = _read_varint(index, at + n)
            self.offsets.append(offset)

    def _at(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        size, crc = struct.unpack("<II", self._at(self.offsets[k], 8))
        packed = self.stream.read(size)
        if zlib.crc32(packed) != crc:
            raise ValueError("damaged block")
        data, at, key = self.unpack(packed), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.offsets)):
            yield from self._block(k)

    def get(self, key: bytes) -> bytes | None:
        """The value of ``key``; the filter answers for most absent keys without a block read."""
        if not all(self.filter[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.filter) * 8)):
            return None
        k = bisect.bisect_right(self.first, key) - 1
        return next((v for x, v in self._block(k) if x == key), None) if k >= 0 else None


def write_tables(docs: DataFrame, folder: str | None = None, end_id: int = 2, tokenizer: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every document and write files in ascending doc_id order; returns the manifest.

    Manifest rows: part, file (order of the files), path, n_docs, n_ids, first and last (keys in hex, which sort as the keys do). Tasks write under a name of
    their own and rename at the end, so a repeated attempt replaces a file by an equal one. A task with
    more than ``file_bytes`` goes on in a further file. Null text counts as empty; null doc_ids come
    first; rows with an equal doc_id follow each other in order of text. Other columns are not read, an empty table gives an empty
    manifest, and a text of any length is one entry.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encoder, writer, stream, done, last, ordinal = WordEncoder(tokenizer), None, None, [], object(), 0

        def close() -> None:
            writer.finish()
            stream.close()
            name = f"{root}/part-{part:06d}-{len(done):04d}.sst"
            files.move(f"{root}/.{part}-{attempt}", name)
            done.append((part, len(done), f"{folder}/part-{part:06d}-{len(done):04d}.sst", len(writer.keys), writer.ids, writer.keys[0].hex(), writer.keys[-1].hex()))

        for batch in sliced(batches, "text"):
            ids, offsets = encoder.encode(*raw_bytes(col(batch, "text")))
            for doc, a, b in zip(col(batch, "doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ordinal = ordinal + 1 if doc == last else 0
                last = doc
                if writer is None:
                    stream = files.open_output_stream(f"{root}/.{part}-{attempt}")
                    writer = TableWriter(stream)
                writer.add(encode_key(doc, ordinal), np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes())
                if writer.at >= file_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done, strict=True) if done else [[]] * 7, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["part", "file", "path", "n_docs", "n_ids", "first", "last"])

    return materialize(ordered.mapInArrow(write, "part int, file int, path string, n_docs bigint, n_ids bigint, first string, last string"))


def find(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of every document with this doc_id, by binary search: the manifest tells the files, their indexes the blocks."""
    low, high = encode_key(doc_id).hex(), encode_key(doc_id, (1 << 32) - 1).hex()
    out, ordinal = [], 0
    for row in manifest.where((F.col("last") >= low) & (F.col("first") <= high)).orderBy("part", "file").collect():  # two files or three
        files, at = file_system(row["path"])
        with files.open_input_file(at) as stream:
            reader = TableReader(stream, stream.size())
            while (value := reader.get(encode_key(doc_id, ordinal))) is not None:
                out.append(np.frombuffer(value, "<u4"))
                ordinal += 1
    return out


def read_tables(manifest: DataFrame) -> DataFrame:
    """Read all files back: doc_id, start (ids before the document), n_tokens, ids_crc32."""
    spark: SparkSession = manifest.sparkSession
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    tasks = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(col(batch, "path").to_pylist(), col(batch, "base").to_pylist(), strict=True):
                files, at = file_system(path)
                with files.open_input_file(at) as stream:
                    rows, start = [], base
                    for key, value in TableReader(stream, stream.size()).scan():
                        rows.append((decode_key(key)[0], start, len(value) // 4, zlib.crc32(value)))
                        start += len(value) // 4
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    def _rows(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.select("path", "base").repartition(tasks).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
