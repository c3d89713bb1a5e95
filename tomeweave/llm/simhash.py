"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints with up to two differing bits agree on at least one of three parts of their bits. Each
distinct fingerprint is therefore filed under its three masked bit patterns, the top nodes of the
index. Under a top node the fingerprints are sorted by Gray rank, which puts those with few differing
bits side by side; runs of them form inner nodes that hold the bits all their members share (a mask
and a pattern). A search adds up the differences to a node's shared bits and leaves out the whole
run once they exceed the limit. A top node with too many members is filed anew under the parts of its
free bits, by the same argument, so no task ever meets an unbounded node and no link is lost.

Links found below a node are reduced to stars, which keeps what is connected, and the stars are put
together by distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._session import materialize, texts
from tomeweave.llm._text import LOWER, col, raw_bytes, sliced, split_words
from tomeweave.operators.cluster import connected_components
from tomeweave.operators.cluster import smallest_reached as stars_of

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: A top node with more members is filed anew under the parts of its free bits.
NODE_MEMBERS = 2048
#: Members of the lowest inner node, and inner nodes of the next.
FAN_OUT = 16

def _bits_of(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, highest first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype(">u8")).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


_WEIGHTS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For every text the XXH64 (seed 42) of its shingles in order; none if it has no word."""
    import xxhash

    words = split_words(LOWER[data], offsets)
    sizes = np.diff(words.offsets)
    n_words = len(sizes)
    spaced_offsets = words.offsets + np.arange(n_words + 1)  # each word with a space after it
    spaced = np.full(int(spaced_offsets[-1]), 0x20, np.uint8)
    if n_words:
        spaced[np.arange(len(words.data)) + np.repeat(np.arange(n_words), sizes)] = words.data
    text = spaced.tobytes()
    digest = xxhash.xxh64_intdigest
    for a, b in zip(words.docs[:-1].tolist(), words.docs[1:].tolist(), strict=True):
        if a == b:
            yield np.zeros(0, np.uint64)
            continue
        begins = spaced_offsets[a : max(a + 1, b - shingle + 1)].tolist()
        ends = (spaced_offsets[min(b, a + shingle) : b + 1] - 1).tolist()
        yield np.fromiter((digest(text[i:j], SEED) for i, j in zip(begins, ends, strict=True)), np.uint64, len(begins))


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every text: bit set if over half the shingles' hashes have it."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for d, hashes in enumerate(shingle_hashes(data, offsets, shingle)):
        out[d] = _WEIGHTS[2 * _bits_of(hashes) > len(hashes)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed bigint, of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = fingerprints_of(*raw_bytes(col(batch, "text")), shingle=shingle)
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(read, "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit number in the reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class GrayIndex:
    """Gray-ordered fingerprints under inner nodes of shared bits."""

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask of shared bits, their pattern), lowest first
        both, any_ = self.values, self.values
        while len(both) > FAN_OUT:
            at = np.arange(0, len(both), FAN_OUT)
            both, any_ = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(any_, at)
            self.levels.append((~(both ^ any_), both))

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) positions within ``distance``."""
        top = self.levels[-1][0] if self.levels else self.values
        q = np.repeat(np.arange(len(queries)), len(top))
        node = np.tile(np.arange(len(top)), len(queries))
        for level in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[level]
            near = _popcount((queries[q] ^ pattern[node]) & mask[node]) <= distance
            q, node = q[near], node[near]
            below = len(self.levels[level - 1][0]) if level else len(self.values)
            q = np.repeat(q, FAN_OUT)
            node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            q, node = q[node < below], node[node < below]
        near = _popcount(queries[q] ^ self.values[node]) <= distance
        return q[near], node[near]


def stars(values: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, its star's centre) that connect exactly what links within ``distance`` connect."""
    index = GrayIndex(values)
    v = index.values
    left, right = [], []
    for at in range(0, len(v), 256):
        q, m = index.search(v[at : at + 256], distance)
        q = q + at
        left.append(q[m < q])
        right.append(m[m < q])
    label = stars_of(len(v), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(len(v)))
    return v[moved], v[label[moved]]


def _parts(bits: list[int]) -> list[list[int]]:
    """``bits`` in DISTANCE + 1 parts."""
    n = DISTANCE + 1
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def star_edges(fps: DataFrame) -> DataFrame:
    """Star edges (src, dst) over distinct fingerprints ``fp``."""
    # the paths to file under: for each, the parts of the bits already fixed
    level = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(str(i)).alias("path"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("pattern")) for i, p in enumerate(_parts(list(range(64))))))).alias("n")).select("fp", F.col("n.path").alias("path"), F.col("n.pattern").alias("pattern"))
    free = {str(i): [b for b in range(64) if b not in p] for i, p in enumerate(_parts(list(range(64))))}
    edges = None
    while True:
        level = materialize(level)
        sizes = level.groupBy("path", "pattern").count()
        big = materialize(sizes.where(F.col("count") > NODE_MEMBERS).select("path", "pattern"))
        some = sizes.where((F.col("count") > 1) & (F.col("count") <= NODE_MEMBERS)).select("path", "pattern")
        found = _search(level.join(some, ["path", "pattern"], "left_semi"))
        edges = found if edges is None else edges.unionByName(found)
        if big.limit(1).count() == 0 or all(len(f) <= DISTANCE for f in free.values()):
            return edges
        filed, under = None, {}
        again = level.join(big, ["path", "pattern"], "left_semi")
        for path, bits in free.items():
            for i, part in enumerate(_parts(bits)):
                under[f"{path}.{i}"] = [b for b in bits if b not in part]
        # the mask of a path fixes what its parents fixed and the new part
        masks = F.create_map(*(x for path, bits in under.items() for x in (F.lit(path), F.lit(_mask([b for b in range(64) if b not in bits])))))
        filed = again.select("fp", F.explode(F.array(*(F.concat("path", F.lit(f".{i}")) for i in range(DISTANCE + 1)))).alias("path"))
        level, free = filed.select("fp", "path", F.col("fp").bitwiseAND(masks[F.col("path")]).alias("pattern")), under


def _search(filed: DataFrame) -> DataFrame:
    """Star edges below each node (path, pattern) of at most NODE_MEMBERS members."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        node = None
        for batch in batches:
            fp = col(batch, "fp").to_numpy().view(np.uint64)
            path, pattern = col(batch, "path").dictionary_encode(), col(batch, "pattern").to_numpy()
            names = path.dictionary.to_pylist()
            code = path.indices.to_numpy()
            if not len(fp):
                continue
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                key = (names[code[a]], int(pattern[a]))
                if key != node:
                    if held:
                        out.append(stars(np.concatenate(held)))
                    held, node = [], key
                held.append(fp[a:b])
            if out:
                yield _edges(out)
        if held:
            yield _edges([stars(np.concatenate(held))])

    def _edges(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]).view(np.int64)) for i in (0, 1)], ["src", "dst"])

    return filed.repartition("path", "pattern").sortWithinPartitions("path", "pattern").select("fp", "path", "pattern").mapInArrow(search, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Words are lower-cased in A-Z; a text with fewer than ``shingle`` words has one shingle of all its
    words, a text without words (null, empty) the fingerprint zero, linked like any other. Repeated rows
    stay repeated. component_id is the smallest doc_id of all documents that links reach (null ids are
    passed over; null if there is no other). An empty table gives no rows, a text of any length counts whole. Extra columns of
    ``docs`` are not read.
    """
    made = materialize(fingerprints(docs, shingle))
    known = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = materialize(star_edges(known.select("fp")))
    linked = connected_components(edges, materialize)
    placed = known.join(linked, known["fp"] == linked["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "component").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's component_id; all columns.

    Documents with null doc_id stay. Repeated rows of the staying doc_id all stay.
    """
    out = near_duplicates(docs, shingle)
    drop = out.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    return docs.join(drop, docs["doc_id"] == drop["doc_id"], "left_anti")
