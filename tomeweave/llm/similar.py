"""Near-duplicates by similarity: wide SimHash fingerprints under a Gray-order hierarchical index, then an exact check.

A 64-bit fingerprint can't be searched at the distance that a Jaccard similarity of 0.8 stands for (about ten bits), so
texts get BITS bits over their distinct shingles: two sets of similarity J differ in about acos(2J / (1 + J)) / pi of them.
The index goes from loose links to exact ones:

1. Equal shingle sets are alike. Of the others, each fingerprint is filed under BANDS masked bit patterns, the top nodes
   of the index. Below a node, fingerprints stand in Gray order and runs of FAN_OUT neighbours form inner nodes that hold
   the bits all their members share; a search adds up the differences to them, word by word, and leaves out whole
   runs once they exceed the limit. What is left are loose links. Each member's closest is held against the
   shingle sets: the sure links.
2. Patterns may part a pair, so top nodes of another kind cover all pairs: if two sets reach the similarity, the first of
   their common shingles, in any fixed order, is among the first n - ceil(similarity * n) + 1 of either (its prefix).
   Each prefix shingle that texts of different loose families have is a top node; those that the same texts
   have are one. Below it the same index is searched, for small sets by parity bits, and gives more loose links.
   Only certain bounds leave a pair out: sizes, places, parity bits, and SURE_SDS standard deviations of the fingerprints.
3. So a pair that reaches the similarity lies in one loose family. In each family all pairs of texts that sure links
   leave apart are held against their whole shingle sets. No link is lost and none is unverified.

A node or family with too many members is dealt in pieces: its largest connected part meets the others piece by piece, the
others meet each other, and no task holds more than a bounded number. Links leave a task as a star for each group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._session import materialize, texts
from tomeweave.llm._text import LOWER, col, give_back, raw_bytes, sliced, split_words
from tomeweave.llm.simhash import SEED, gray_rank, stars_of
from tomeweave.operators.cluster import connected_components

SHINGLE, SIMILARITY = 5, 0.8
BITS = 1024
#: Masked patterns of a fingerprint, and bits of one: as many as part all but 2**-SPARE unrelated members, and so many more.
BANDS, SPARE = 16, 3
#: Members of a pattern or prefix shingle in a piece, shingles of a family in a piece, members of an inner node.
NODE_MEMBERS, FAMILY_SHINGLES, FAN_OUT = 2048, 1 << 20, 16
#: Words compared at a time.
WORDS_AT_ONCE = 4
#: Standard deviations beyond the expected distance that leave a pair out, for sets of LEAST_SIZE shingles or more: in smaller
#: ones ties make distances scatter more, and parity bits tell them apart. Sets of FILED shingles or more are filed under patterns.
SURE_SDS, LEAST_SIZE, FILED = 7, 256, 32
#: Frequent shingles come last in the order: those of so many documents' sample, at most so many. Any order is exact.
SAMPLE_DOCS, FREQUENT = 8192, 1 << 16
#: Parity bits of a shingle set, and prefix shingles that are broadcast at most.
PARITY, BROADCAST = 512, 1 << 20

_WIDTH = BITS // 64
_ONES = np.uint64(0x0101010101010101)
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, _WIDTH + 256, dtype=np.uint64)
_ODD, _BYTES, _BASE = _DRAWN[:_WIDTH] | np.uint64(1), _DRAWN[_WIDTH:], 0x9E3779B97F4A7C15


def share_of(similarity: float) -> float:
    """Expected share of differing bits between equally large sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limit_of(similarity: float) -> int:
    """Most differing bits of a pair that is looked at."""
    p = share_of(similarity)
    return round(BITS * p + SURE_SDS * math.sqrt(BITS * p * (1 - p)))


def bands_of(n: int) -> list[np.ndarray]:
    """For each band the bits of its pattern, for ``n`` fingerprints. More of them take more bits and not more bands."""
    mask = math.ceil(math.log2(max(n, 2))) + SPARE
    order = np.random.default_rng(SEED + 1)
    bits = np.concatenate([order.permutation(BITS) for _ in range(-(-BANDS * mask // BITS))])
    return [bits[b * mask : (b + 1) * mask] for b in range(BANDS)]


def _finish(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the 64."""
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of text d, ascending, are hashes[bounds[d]:bounds[d + 1]].

    A word is hashed as a polynomial over its bytes, from differences of running sums; a shingle as a sum of its words'
    mixed hashes, each times the factor of its place.
    """
    words = split_words(LOWER[data], offsets)
    n, docs = len(words.offsets) - 1, words.docs
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[words.data] * _powers(_BASE, len(words.data))[:-1], dtype=np.uint64)])
    hashed = (summed[words.offsets[1:]] - summed[words.offsets[:-1]]) * _powers(pow(_BASE, -1, 1 << 64), len(words.data))[words.offsets[:-1]]
    hashed = _finish(hashed + np.diff(words.offsets).astype(np.uint64) * np.uint64(_BASE))
    left = np.repeat(docs[1:], np.diff(docs)) - np.arange(n)  # words up to the text's end
    padded = np.concatenate([hashed, np.zeros(shingle, np.uint64)])
    total = np.zeros(n, np.uint64)
    for t, factor in enumerate(_powers(_BASE, shingle)[1:]):
        total += np.where(left > t, padded[t : t + n] * factor, np.uint64(0))
    begins = left >= shingle
    begins[docs[:-1][np.diff(docs) > 0]] = True
    hashes = _finish(total[begins])
    bounds = np.concatenate([[0], np.cumsum(begins)])[docs]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def wide_fingerprints_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BITS / 8) bytes: majority bits over each text's hashes; ties go to the least hash's bit; without hashes all are zero.

    Eight bits of every byte are counted in turn, in the bytes of 64-bit sums over at most 255 rows.
    """
    full = np.flatnonzero(np.diff(bounds))
    begins, sizes = bounds[:-1][full], np.diff(bounds)[full]
    counts = np.zeros((len(full), BITS), np.int32)
    cuts = np.unique(np.concatenate([np.arange(0, len(hashes), 255), begins]))
    owner = np.searchsorted(begins, cuts, side="right") - 1
    ends = np.append(cuts[1:], len(hashes))
    for at in range(0, len(cuts), 64):
        a, b = cuts[at], ends[min(at + 64, len(cuts)) - 1]
        bits = _finish(hashes[a:b, None] * _ODD[None, :])
        own = owner[at : at + 64]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for s in range(8):
            sums = np.add.reduceat((bits >> np.uint64(s)) & _ONES, cuts[at : at + 64] - a, axis=0).view(np.uint8)
            counts[own[first], s::8] += np.add.reduceat(sums, first, axis=0, dtype=np.int32)
    tie = np.unpackbits(_finish(hashes[begins, None] * _ODD[None, :]).view(np.uint8), axis=1, bitorder="little")
    out = np.zeros((len(bounds) - 1, BITS // 8), np.uint8)
    out[full] = np.packbits(2 * counts + tie > sizes[:, None], axis=1, bitorder="little")
    return out


def wide_fingerprints(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of every row doc_id, fp (BITS / 8 bytes), k1, k2 and n (128 bits of digest and size of its shingle set), prefix and parity."""
    ranks = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))
    least = _millionths(similarity)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            hashes, bounds = shingles_of(*raw_bytes(col(batch, "text")), shingle)
            found = wide_fingerprints_of(hashes, bounds)
            n = np.diff(bounds)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_finish(hashes * odd), dtype=np.uint64)]) for odd in _ODD[:2]]
            digests = [pa.array((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64)) for t in sums]
            prefix, at = prefixes_of(hashes, bounds, ranks.value, least)
            parts = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(prefix.view(np.int64)))
            made = [col(batch, "doc_id"), pa.array([f.tobytes() for f in found], pa.binary()), *digests, pa.array(n.astype(np.int32)), parts, pa.array([f.tobytes() for f in parity_of(hashes, bounds)], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "fp", "k1", "k2", "n", "prefix", "parity"])

    rows = texts(docs)
    return rows.mapInArrow(read, "doc_id bigint, fp binary, k1 bigint, k2 bigint, n int, prefix array<bigint>, parity binary")


def frequent_shingles(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, their ranks from 1 on by frequency) of shingles that several documents of a sample have."""
    share = max(1, docs.count() // SAMPLE_DOCS)
    drawn = shingle_sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), shingle)
    counts = drawn.select(F.explode("shingles").alias("h")).groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(FREQUENT)
    h = counts.select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)[::-1]
    order = np.argsort(h)
    return h[order], order + 1


def _millionths(similarity: float) -> int:
    return round(similarity * 1_000_000)


def prefixes_of(hashes: np.ndarray, bounds: np.ndarray, ranks: tuple[np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each text's prefix, rare shingles first."""
    n = np.diff(bounds)
    known, rank = ranks
    if len(known) and len(hashes):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        owner = np.repeat(np.arange(len(n)), n)
        hashes = hashes[np.argsort(owner * (len(known) + 1) + np.where(known[at] == hashes, rank[at], 0), kind="stable")]
    size = np.where(n > 0, n + (-least * n) // 1_000_000 + 1, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    return hashes[np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], size)], ends


def parity_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, PARITY / 8) bytes: is the number of shingles that fall on a bit odd? Sets differ in as many shingles as bits at least."""
    texts = len(bounds) - 1
    place = np.repeat(np.arange(texts), np.diff(bounds)) * PARITY + (_finish(hashes * _ODD[2]) % np.uint64(PARITY)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=texts * PARITY) & 1).astype(np.uint8).reshape(texts, PARITY), axis=1)


def _matrix(fps: pa.Array) -> np.ndarray:
    """(rows, words) of a binary array of equally long values."""
    return np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(len(fps), _WIDTH)


class WideGrayIndex:
    """Wide fingerprints in Gray order of their first word, under inner nodes of the bits that neighbours share."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values[:, 0]), kind="stable")
        self.values = values[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask of shared bits, their pattern), lowest first
        both = any_ = self.values
        while len(both) > FAN_OUT:
            at = np.arange(0, len(both), FAN_OUT)
            both, any_ = np.bitwise_and.reduceat(both, at, axis=0), np.bitwise_or.reduceat(any_, at, axis=0)
            self.levels.append((~(both ^ any_), both))

    @staticmethod
    def _within(q: np.ndarray, at: np.ndarray, pattern: np.ndarray, node: np.ndarray, mask: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs (at, node) whose differences, added up over the words, don't exceed the limit, and the differences."""
        sums = np.zeros(len(at), np.uint16)
        for w in range(0, q.shape[1], WORDS_AT_ONCE):
            words = slice(w, w + WORDS_AT_ONCE)
            differ = q[at, words] ^ pattern[node, words]
            sums += np.bitwise_count(differ if mask is None else differ & mask[node, words]).sum(axis=1, dtype=np.uint16)
            near = sums <= limit
            at, node, sums = at[near], node[near], sums[near]
        return at, node, sums

    def pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(later, earlier, differing bits) of positions in Gray order, of all pairs within the limit."""
        top = self.levels[-1][0] if self.levels else self.values
        for begin in range(0, len(self.values), 64):
            q = self.values[begin : begin + 64]
            at, node = np.repeat(np.arange(len(q)), len(top)), np.tile(np.arange(len(top)), len(q))
            for level in range(len(self.levels) - 1, -1, -1):
                first = FAN_OUT ** (level + 1) * node <= begin + at  # a run that begins later holds no earlier member
                at, node = at[first], node[first]
                mask, pattern = self.levels[level]
                at, node, _ = self._within(q, at, pattern, node, mask, limit)
                below = len(self.levels[level - 1][0]) if level else len(self.values)
                at, node = np.repeat(at, FAN_OUT), (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                at, node = at[node < below], node[node < below]
            earlier = node < begin + at
            at, node, bits = self._within(q, at[earlier], self.values, node[earlier], None, limit)
            yield begin + at, node, bits


def _nodes(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by whole-number ``keys``, those of equal keys together."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([col(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
        cuts = (np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(k)], strict=True):
            if held and tuple(k[a]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = tuple(k[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
    give_back()


def pattern_links(known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Loose links (src, dst, bits) between the nodes of ``known`` (node, fp): of each member, below each pattern, the closest
    that stands before it, and others that connect what is connected."""
    bands, limit = bands_of(known.count()), limit_of(similarity)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                bits = np.unpackbits(_matrix(col(part, "fp")).view(np.uint8), axis=1, bitorder="little")
                for b, pick in enumerate(bands):
                    packed = np.packbits(bits[:, pick], axis=1)
                    pattern = np.fromiter((xxhash.xxh64_intdigest(p.tobytes(), b) for p in packed), np.uint64, len(packed)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([col(part, "node"), pa.array(pattern)], ["node", "pattern"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _nodes(batches, ("pattern", "piece")):
            if table.num_rows > 1:
                index = WideGrayIndex(_matrix(table.column("fp")))
                i, j, d = (np.concatenate(x) for x in zip(*index.pairs(limit), strict=True))
                if len(i):
                    kept = candidates(np.arange(table.num_rows), i, j, d)
                    node = table.column("node").to_numpy()[index.order]
                    yield pa.RecordBatch.from_arrays([pa.array(node[i[kept]]), pa.array(node[j[kept]]), pa.array(d[kept].astype(np.int32))], ["src", "dst", "bits"])

    # only patterns and numbers are shuffled for all; fingerprints go where a pattern has several members
    filed = known.mapInArrow(file, "node bigint, pattern bigint")
    several = filed.groupBy("pattern").count().where("count > 1")
    piece = F.pmod(F.xxhash64("node", "pattern"), F.ceil(F.col("count") / NODE_MEMBERS)).cast("int")
    shared = filed.join(several, "pattern").select("node", "pattern", piece.alias("piece"))
    rows = shared.join(known, "node").select("node", "pattern", "piece", "fp")
    return rows.repartition("pattern", "piece").sortWithinPartitions("pattern", "piece").mapInArrow(search, "src bigint, dst bigint, bits int")


def candidates(label: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j): each member's closest, and a forest of closest pairs."""
    open_ = np.argsort(d, kind="stable")
    chosen = [open_[np.unique(x[open_], return_index=True)[1]] for x in (i, j)]
    while len(open_):
        new = np.concatenate([open_[np.unique(label[x[open_]], return_index=True)[1]] for x in (i, j)])
        chosen.append(new)
        label = stars_of(len(label), np.concatenate([i[new], np.arange(len(label))]), np.concatenate([j[new], label]))
        open_ = open_[label[i[open_]] != label[j[open_]]]
    return np.unique(np.concatenate(chosen))


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and shingles (distinct hashes of the whole text) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            hashes, bounds = shingles_of(*raw_bytes(col(batch, "text")), shingle)
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["doc_id", "shingles"])

    return texts(docs).mapInArrow(read, "doc_id bigint, shingles array<bigint>")


def alike_enough(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose shingle sets have at least this Jaccard similarity."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct()
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = materialize(shingle_sets(own.join(ends, "doc_id", "left_semi"), shingle))
    a, b = (sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"s_{end}")) for end in ("src", "dst"))
    both = F.size(F.array_intersect("s_src", "s_dst"))
    # in whole millionths, so that a similarity of just 0.8 is not lost to rounding
    enough = both.cast("bigint") * 1_000_000 >= (F.size("s_src") + F.size("s_dst") - both) * F.lit(_millionths(similarity)).cast("bigint")
    return pairs.join(a, "src").join(b, "dst").where(enough).select("src", "dst").distinct()


def _looked_up(rows: DataFrame) -> DataFrame:
    """``rows`` written out, and broadcast in a join if they are no more than BROADCAST."""
    rows = materialize(rows)
    return F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows


def _dealt(rows: DataFrame, key: str, part: str, size: Column, most: int) -> DataFrame:
    """``rows`` with cell, a copy for each cell of its ``key``, and own, its piece: every two rows of different ``part`` meet in a cell.

    A key of at most ``most`` in size is one cell. In others the largest part is cut in pieces that meet only those of the
    other parts; pieces of the others meet each other too.
    """
    by_part = rows.groupBy(key, part).agg(F.sum(size).alias("s"))
    sums = by_part.groupBy(key).agg(F.sum("s").alias("s"), F.max(F.struct("s", part)).alias("largest")).where(F.col("s") > most)
    sums = sums.select(key, F.col(f"largest.{part}").alias("major"), F.ceil(F.col("largest.s") / most).cast("int").alias("majors"), F.ceil((F.col("s") - F.col("largest.s")) / most).cast("int").alias("minors"))
    dealt = rows.join(_looked_up(sums), key, "left")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(F.col(part) == F.col("major"), F.col("majors")).otherwise(F.greatest(F.col("minors"), F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.col("minors") - 1)
    # minors' pieces are numbered first; cells are pairs of pieces
    cells = (
        F.when(F.col("major").isNull(), F.array(F.lit(0).cast("bigint")))
        .when(F.col(part) == F.col("major"), F.transform(others, lambda p: p.cast("bigint") * (1 << 31) + F.col("minors") + drawn))
        .otherwise(
            F.concat(
                F.transform(others, lambda p: F.least(p, drawn).cast("bigint") * (1 << 31) + F.greatest(p, drawn)),
                F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda p: drawn.cast("bigint") * (1 << 31) + F.col("minors") + p),
            )
        )
    )
    return dealt.where("major is null or minors > 0").withColumn("cell", F.explode(cells)).drop("major", "majors", "minors")


def prefix_links(made: DataFrame, family: DataFrame, similarity: float) -> DataFrame:
    """Loose links (src, dst) that, with those inside the families of ``family`` (doc_id, family), connect every pair that may
    reach the similarity; ``made`` as of wide_fingerprints, without texts that are alike."""
    least, limit = _millionths(similarity), limit_of(similarity)
    base = made.select("doc_id", "n", "prefix").join(_looked_up(family), "doc_id", "left").select("doc_id", F.coalesce("family", "doc_id").alias("family"), "n", "prefix")
    tokens = base.select("doc_id", "family", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("family").alias("a"), F.max("family").alias("b"), F.bit_xor(F.xxhash64("doc_id")).alias("x"))
    mixed = _looked_up(tokens.where("a <> b").select("token", F.xxhash64("a", "b", "x").alias("node")))  # equal texts, equal node
    rows = base.select("doc_id", "family", "n", F.posexplode("prefix").alias("at", "token")).join(mixed, "token")
    rows = materialize(rows.groupBy("doc_id", "family", "n", "node").agg((F.col("n") - F.min("at")).alias("reach")))
    dealt = _dealt(rows, "node", "family", F.lit(1), NODE_MEMBERS).join(made.select("doc_id", F.col("n").alias("size"), "fp", "parity"), "doc_id").where("n = size").drop("size")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _nodes(batches, ("node", "cell")):
            family = table.column("family").to_numpy()
            if (family == family[0]).all():
                continue
            n, reach = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "reach"))
            parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(len(n), PARITY // 64)

            def possible(i: np.ndarray, j: np.ndarray, family=family, n=n, reach=reach, parity=parity) -> tuple[np.ndarray, np.ndarray]:
                need = -((-least * (n[i] + n[j])) // (1_000_000 + least))
                fits = (family[i] != family[j]) & (np.minimum(reach[i], reach[j]) >= need)
                i, j, need = i[fits], j[fits], need[fits]
                fits = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j] - 2 * need
                return i[fits], j[fits]

            found = []
            large = np.flatnonzero(n >= LEAST_SIZE)
            if len(large) > 1:
                index = WideGrayIndex(_matrix(table.column("fp").take(pa.array(large))))
                place = large[index.order]
                found += [possible(place[i], place[j]) for i, j, _ in index.pairs(limit)]
            order = np.argsort(n, kind="stable")
            some = order[n[order] < LEAST_SIZE]
            for k in range(len(some)):  # with all that are no smaller; at most so much larger
                end = int(np.searchsorted(n[order], 1_000_000 * n[some[k]] // least, side="right"))
                found.append(possible(np.full(end - k - 1, some[k]), order[k + 1 : end]))
            if found and sum(len(i) for i, _ in found):
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                parts, own = np.unique(family, return_inverse=True)
                label = stars_of(len(parts), own[i], own[j])
                moved = np.flatnonzero(label != np.arange(len(parts)))
                yield pa.RecordBatch.from_arrays([pa.array(parts[moved]), pa.array(parts[label[moved]])], ["src", "dst"])

    return dealt.repartition("node", "cell").sortWithinPartitions("node", "cell").select("doc_id", "family", "n", "reach", "fp", "parity", "node", "cell").mapInArrow(search, "src bigint, dst bigint")


def family_links(docs: DataFrame, family: DataFrame, sure: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (src, dst) between ``sure`` groups (doc_id, part): each is of two texts of one family that reach the similarity.

    ``family`` has doc_id and family of all documents to compare. With the sure links they connect all such texts.
    """
    least = _millionths(similarity)
    placed = family.join(sure, "doc_id", "left").select("doc_id", "family", F.coalesce("part", "doc_id").alias("part"))
    mixed = placed.groupBy("family").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("family")
    placed = materialize(placed.join(_looked_up(mixed), "family", "left_semi"))
    sets = shingle_sets(docs.join(placed.select("doc_id"), "doc_id", "left_semi"), shingle)
    rows = materialize(sets.join(placed, "doc_id").where(F.size("shingles") > 0))
    sizes = rows.select("doc_id", "family", "part", F.size("shingles").alias("n"))
    cells = _dealt(sizes, "family", "part", F.col("n"), FAMILY_SHINGLES).select("doc_id", "family", "cell", "n").distinct()
    dealt = cells.join(rows, ["doc_id", "family"]).where(F.size("shingles") == F.col("n"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _nodes(batches, ("family", "cell")):
            part = table.column("part").to_numpy()
            if (part == part[0]).all():
                continue
            n = table.column("n").to_numpy().astype(np.int64)
            order = np.argsort(n, kind="stable")
            n, part = n[order], part[order]
            lists = table.column("shingles").combine_chunks().take(pa.array(order))
            names, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            bounds = np.concatenate(([0], np.cumsum(n)))
            parts, label = np.unique(part, return_inverse=True)
            group = np.arange(len(parts))  # of each part, merged as links are found
            held = np.zeros(len(names), bool)
            for k in range(1, len(n)):
                low = int(np.searchsorted(n[:k], -((-least * n[k]) // 1_000_000)))
                if low == k or (group[label[low:k]] == group[label[k]]).all():
                    continue
                own = flat[bounds[k] : bounds[k + 1]]
                held[own] = True
                both = np.add.reduceat(held[flat[bounds[low] : bounds[k]]], bounds[low:k] - bounds[low], dtype=np.int64)
                held[own] = False
                # in whole millionths, so that a similarity of just 0.8 is not lost to rounding
                for other in np.unique(group[label[low:k][both * 1_000_000 >= least * (n[low:k] + n[k] - both)]]).tolist():
                    group[group == other] = group[label[k]]
            moved = np.flatnonzero(group != np.arange(len(parts)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(parts[moved]), pa.array(parts[group[moved]])], ["src", "dst"])

    return dealt.select("doc_id", "family", "part", "n", "shingles", "cell").repartition("family", "cell").sortWithinPartitions("family", "cell").mapInArrow(verify, "src bigint, dst bigint")


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable by links) of every distinct non-null doc_id.

    Words as in ``simhash``; a text with fewer than ``shingle`` words has one shingle of all its words, and texts
    without words (null, empty) are alike. Rows of one doc_id count as one document. Extra columns are not read, an
    empty table gives no rows, and a text of any length is compared whole. Shingles are compared by 64-bit hashes.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = materialize(wide_fingerprints(docs, shingle, similarity))
    same = ["k1", "k2", "n"]
    repeated = _looked_up(made.groupBy(*same).agg(F.min("doc_id").alias("dst"), F.count("*").alias("c")).where("c > 1").drop("c"))
    repeats = materialize(made.select("doc_id", *same).join(repeated, same).where("doc_id <> dst").distinct())
    alike = repeats.select(F.col("doc_id").alias("src"), "dst")
    single = made.where("n > 0").join(_looked_up(repeats.drop("dst")), ["doc_id", *same], "left_anti")
    found = materialize(pattern_links(single.where(F.col("n") >= FILED).select(F.col("doc_id").alias("node"), "fp"), similarity))
    closest = materialize(found.groupBy("src").agg(F.min_by("dst", F.struct("bits", "dst")).alias("dst")).where("src <> dst"))
    sure = materialize(alike.unionByName(alike_enough(docs, closest, shingle, similarity)))
    loose = found.select("src", "dst").unionByName(alike)
    named = lambda linked, name: linked.select(F.col("node").alias("doc_id"), F.col("component").alias(name))
    family = materialize(named(connected_components(loose, materialize), "family"))
    more = materialize(prefix_links(single, family, similarity))
    if more.limit(1).count():
        family = materialize(named(connected_components(loose.unionByName(more), materialize), "family"))
    part = materialize(named(connected_components(sure, materialize), "part"))
    compared = family.join(_looked_up(repeats.select("doc_id").distinct()), "doc_id", "left_anti")  # one of each equal texts
    links = sure.unionByName(family_links(docs, compared, part, shingle, similarity))
    linked = connected_components(links, materialize)
    ids = made.select("doc_id").distinct()
    return ids.join(linked, ids["doc_id"] == linked["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest; all columns.

    Documents with null doc_id stay. Repeated rows of the staying doc_id all stay.
    """
    out = similar_documents(docs, shingle, similarity)
    drop = out.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(drop, docs["doc_id"] == drop["doc_id"], "left_anti")
