"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Bulk-synchronous best fit. Documents are cut into pieces of at most ``capacity`` ids. Pieces are
range-sorted by length, longest first; one superstep takes one length. In it a successor sweep walks
the open sequences in order of their gap, smallest gap that fits first; pieces of one length and
sequences of one gap are told apart by rank, so the k-th piece takes the k-th sequence and no two
claim the same place; matched gaps shrink and are open again in the same superstep; what finds no
gap opens new sequences. This is best-fit decreasing.

Lengths and gaps lie in 1..capacity whatever the size of the corpus, so the sweep works on runs of
sequences with equal gap and on counts of pieces by length. Only those counts reach the driver
(at most PARTS numbers for each length, and one for each RANKED_TOGETHER pieces). The pieces themselves get their ranks and places on the executors.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tomeweave.llm._session import materialize, texts
from tomeweave.llm._text import col, raw_bytes, sliced
from tomeweave.llm._tokens import WordEncoder

#: Ranks of a length are counted in parts: of so many pieces at most, so that a frequent length is dealt to as many tasks as it
#: needs, and of FEWEST at least while there are no more than PARTS.
RANKED_TOGETHER, FEWEST, PARTS = 1 << 16, 256, 32
#: Bytes of text encoded at once; a task's memory follows it.
SLICE_BYTES = 2 << 20


def best_fit_plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go.

    counts[l] is the number of pieces of length l. Returns runs: pieces of ``length`` with ranks from
    ``rank`` go to sequences from ``sequence`` on, one each, at ``offset``. Runs are sorted by length, rank.
    """
    runs: list[tuple[int, int, int, int]] = []
    gaps: list[int] = []  # gaps that some open sequence has, ascending
    open_runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(gap: int, begin: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in open_runs:
                bisect.insort(gaps, gap)
                open_runs[gap] = []
            open_runs[gap].append((begin, n))

    for length in range(capacity, 0, -1):
        left, rank = int(counts[length]), 0
        while left and (at := bisect.bisect_left(gaps, length)) < len(gaps):
            gap = gaps[at]
            begin, n = open_runs[gap].pop()
            if not open_runs[gap]:
                del open_runs[gap], gaps[at]
            take = min(left, n)
            runs.append((length, rank, begin, capacity - gap))
            put(gap, begin + take, n - take)
            put(gap - length, begin, take)
            left, rank = left - take, rank + take
        each = capacity // length
        full, rest = divmod(left, each)
        for slot in range(each if full else 0):
            runs.append((length, rank, opened, slot * length))
            rank += full
        put(capacity - each * length, opened, full)
        opened += full
        for slot in range(rest):
            runs.append((length, rank, opened, slot * length))
            rank += 1
        if rest:
            put(capacity - rest * length, opened, 1)
            opened += 1
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "n": np.array([opened])}


def cut_pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, uid, and ids (little-endian uint32) if asked for.

    A document's ids are those of its whole text (null: none), then ``end_id``. ``uid`` tells pieces of
    repeated rows apart.
    """
    schema = "doc_id bigint, uid bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = WordEncoder(tokenizer)
        uid = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, "text", SLICE_BYTES):
            ids, offsets = encoder.encode(*raw_bytes(col(batch, "text")))
            rows: list[list] = [[] for _ in range(7)]
            for doc, (a, b) in zip(col(batch, "doc_id").to_pylist(), zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), strict=True):
                whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes()
                for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, uid, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
                    uid += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "uid", "piece", "start", "length", "ids_crc32", "ids"]
            n = 7 if with_ids else 6
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows[:n], kinds[:n], strict=True)], names[:n])

    return texts(docs).mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` ids as best-fit decreasing finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). Null or
    empty text: one piece with the end id. Null doc_id and repeated rows are packed like any other.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, capacity, end_id, tokenizer, with_ids))
    counts = np.zeros(capacity + 1, np.int64)
    by_length = pieces.groupBy("length").count()  # at most capacity rows
    for length, n in by_length.collect():
        counts[length] = n
    salts = np.maximum(np.maximum(1, -(-counts // RANKED_TOGETHER)), np.minimum(PARTS, -(-counts // FEWEST)))
    begins = np.concatenate(([0], np.cumsum(salts)))  # of a length's parts
    salt_of = F.greatest(F.ceil(F.col("count") / RANKED_TOGETHER), F.least(F.lit(PARTS), F.ceil(F.col("count") / FEWEST)))
    many = by_length.select("length", salt_of.alias("salts")).where("salts > 1")
    salted = pieces.join(F.broadcast(many), "length", "left").withColumn("salt", F.pmod(F.xxhash64("uid"), F.coalesce("salts", F.lit(1)))).drop("salts")
    counted = np.zeros(begins[-1], np.int64)
    for length, salt, n in salted.groupBy("length", "salt").count().collect():
        counted[begins[length] + salt] = n
    before = np.cumsum(counted) - counted
    before -= np.repeat(before[begins[:-1]], salts)
    plan = best_fit_plan(counts, capacity)
    order = np.lexsort((plan["rank"], plan["length"]))
    shared = spark.sparkContext.broadcast(
        {"key": (plan["length"][order] << 44) + plan["rank"][order], "before": before, "begins": begins} | {k: plan[k][order] for k in ("rank", "sequence", "offset")}
    )
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")).cast("bigint"))
    out = StructType([f for f in pieces.schema if f.name != "uid"]).add("sequence_id", LongType()).add("offset", LongType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            length, salt, nth = (col(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "nth"))
            rank = p["before"][p["begins"][length] + salt] + nth - 1
            at = np.searchsorted(p["key"], (length << 44) + rank, side="right") - 1
            kept = [col(batch, f.name) for f in out.fields[:-2]]
            found = [pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])] if len(at) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(kept + found, out.fieldNames())

    return ranked.mapInArrow(place, out)
