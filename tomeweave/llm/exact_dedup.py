"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its last bytes meets a condition, so equal passages give
equal chunks. A chunk's identifier is its SHA-256; the distinct chunks are verified by length and a
second, independent digest, and the job fails if one identifier stands for two contents. A document
is then its recipe, the ordered list of identifiers, and only recipes are shuffled and compared: a
long text never moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._session import materialize, texts, unused
from tomeweave.llm._text import col, raw_bytes, sliced

#: Chunk sizes in bytes. A text of up to LEAST is one chunk.
LEAST, MEAN, MOST = 2048, 8192, 65536


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; they depend on nothing but nearby content."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = data.astype(np.uint32) * np.uint32(2654435761)
    for step, factor in ((1, 0x01000193), (2, 0x9E3779B1), (4, 0x85EBCA77), (8, 0xC2B2AE3D)):  # of the last 2, 4, 8, 16 bytes
        h[step:] = h[step:] + h[:-step] * np.uint32(factor)
    cuts = np.flatnonzero((h >> np.uint32(7)) % np.uint32(MEAN - LEAST) == 0) + 1
    ends, begin = [], 0
    while n - begin > LEAST:
        at = np.searchsorted(cuts, begin + LEAST)
        end = int(cuts[at]) if at < len(cuts) else n
        begin = min(end, begin + MOST, n)
        ends.append(begin)
    if begin < n:
        ends.append(n)
    return ends


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, uid, n_bytes, text_sha256, chunks (id, a, b: halves of the check digest, n) of every document."""
    schema = "doc_id bigint, uid bigint, n_bytes bigint, text_sha256 string, recipe binary, chunks array<struct<id: binary, a: bigint, b: bigint, n: bigint>>"
    chunk = pa.struct([("id", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, "text"):
            data, offsets = raw_bytes(col(batch, "text"))
            whole = data.tobytes()
            sizes, shas, made, lists = np.diff(offsets), [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                begin, parts, ids = a, [], []
                for end in chunk_ends(data[a:b]):
                    part = whole[begin : a + end]
                    check = hashlib.blake2b(part, digest_size=16).digest()
                    ids.append(hashlib.sha256(part).digest())
                    parts.append({"id": ids[-1], "a": int.from_bytes(check[:8], "big", signed=True), "b": int.from_bytes(check[8:], "big", signed=True), "n": len(part)})
                    begin = a + end
                shas.append(ids[0].hex() if len(ids) == 1 else hashlib.sha256(whole[a:b]).hexdigest())
                made.append(parts)
                lists.append(b"".join(ids))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [col(batch, "doc_id"), pa.array(np.arange(uid, uid + n)), pa.array(sizes), pa.array(shas, pa.string()), pa.array(lists, pa.binary()), pa.array(made, pa.list_(chunk))],
                ["doc_id", "uid", "n_bytes", "text_sha256", "recipe", "chunks"],
            )
            uid += n

    return texts(docs).mapInArrow(cut, schema)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical (null equals empty). Of equal texts the row with the largest doc_id
    stays; of repeated rows with that doc_id one stays; null doc_ids stay only among themselves, with
    keep_id null. Empty table: no rows. Extra columns of ``docs`` are not read.
    """
    made = materialize(recipes(docs))
    checks = made.select(F.explode("chunks").alias("c")).groupBy("c.id").agg(*(f(f"c.{k}").alias(f"{k}_{n}") for k in "abn" for n, f in (("lo", F.min), ("hi", F.max))))
    if checks.where("a_lo <> a_hi or b_lo <> b_hi or n_lo <> n_hi").limit(1).count():
        raise ValueError("two chunks share an identifier")
    rows = made.drop("chunks")
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("best"))
    return rows.join(groups, "recipe").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256", "n_bytes"
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns.

    Rows are told apart by doc_id and the SHA-256 of the text, computed alike on both sides; of repeated
    such rows one stays. Texts are shuffled once: repeated rows fall together on that key before the
    kept keys are looked up on the same partitioning. Nulls, empty and long texts as in exact_dedup; an empty table
    stays empty, and columns of any name pass through.
    """
    sha, key = unused(docs, "sha", "key")
    made = lambda column: F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("null")), column), 256)
    kept = exact_dedup(docs).where("kept").select(made(F.col("text_sha256")).alias(key)).distinct()
    marked = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).withColumn(key, made(F.col(sha))).drop(sha)
    return marked.dropDuplicates([key]).join(kept, key, "left_semi").drop(key)
