"""Removal of passages that start earlier in the corpus, by deep-shallow suffix sorting.

Two equal strings of WINDOW bytes have the same anchor, the byte string of GRAM bytes with the least
hash inside them, at the same place. So only suffixes around anchors with equal hash can share a
WINDOW-byte prefix:

1. Each task stores its texts in compressed blocks in the shared folder and sends on one row per
   anchor: hash of the anchor, digest of its surroundings (all WINDOW-byte strings that hold it), place.
   Of equal surroundings within a block only the first goes on; the others are repeats already.
2. Rows meet by anchor. All but the first of equal surroundings are repeats in full. Where surroundings
   differ, the first of each is fetched from its block. An anchor that has several surroundings in one block
   is spread over tasks by them, and a mark tells its other rows; so a task gets a row or two for each block.
3. The suffixes that start in those surroundings are sorted, those of one anchor and one distance to it
   together: three-way multikey quicksort over 8-byte symbols to SHALLOW bytes, then a blind trie for each group
   that is still equal (one of more than FEW members is first parted further by quicksort). Suffixes equal over WINDOW bytes but the earliest are repeats. An anchor with more than
   MOST_ROWS surroundings is dealt further by the bytes that all strings of a range of distances have in common,
   halving the range each time, so no task holds more; at a single distance those are the strings themselves.
4. Per block, spans are united and the rest of each text is hashed (or returned).

Only equal surroundings are told by digest (128 bits besides the anchor); everything else compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._session import file_system, materialize, texts, work_dir
from tomeweave.llm._text import col, give_back, raw_bytes, sliced

WINDOW, GRAM, SHALLOW, FEW = 100, 20, 24, 12
#: An anchor can stand at 0 to REACH bytes after the start of a WINDOW-byte string.
REACH = WINDOW - GRAM
BLOCK_BYTES = 4 << 20
#: Suffixes sorted at once, and surroundings of one anchor that are sorted together.
SORTED_AT_ONCE, MOST_ROWS = 1 << 20, 1 << 13
#: Neighbouring distances whose strings are ruled out together before sorting.
NEAR = 20

_ANCHOR, _COVER, _BLOCK, _FETCH, _SPREAD, _MARK = range(1, 7)
_FIELDS = [("kind", pa.int8()), ("key", pa.int64()), ("ctx", pa.int64()), ("more", pa.int64()), ("block", pa.int64()), ("doc", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("doc_id", pa.int64())]
_SCHEMA = "kind tinyint, key bigint, ctx bigint, more bigint, block bigint, doc int, a int, b int, doc_id bigint"
_NULL_ID, _U64 = -(1 << 63), (1 << 64) - 1


def _gram_hashes(d: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each byte on."""
    m = len(d) - GRAM + 1
    w = d.astype(np.uint64)
    h4 = w[:-3] | (w[1:-2] << np.uint64(8)) | (w[2:-1] << np.uint64(16)) | (w[3:] << np.uint64(24))
    h4 = h4 * np.uint64(0x9E3779B97F4A7C15)
    h4 ^= h4 >> np.uint64(31)
    h8 = h4[:-4] * np.uint64(0xBF58476D1CE4E5B9) + h4[4:]
    h8 ^= h8 >> np.uint64(29)
    h = (h8[:m] * np.uint64(0x94D049BB133111EB) + h8[8 : 8 + m]) * np.uint64(0xD6E8FEB86659FD93) + h4[16 : 16 + m]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each n neighbours."""
    out, have = x, 1
    while have * 2 <= n:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(x) - n + 1], out[n - have : n - have + len(x) - n + 1]) if n > have else out


def anchors(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of one text's WINDOW-byte strings."""
    if len(d) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(d)
    least = _sliding(h, REACH + 1, np.minimum)  # for each string, the least hash in it
    padded = np.zeros(len(least) + 2 * REACH, np.uint64)
    padded[REACH : REACH + len(least)] = least
    at = np.flatnonzero(_sliding(padded, REACH + 1, np.maximum) == h)
    return at, h[at]


def _table(kind, key, ctx, more, block, doc, a, b, doc_id) -> pa.RecordBatch:
    n = len(a)
    values = [kind, key, ctx, more, block, doc, a, b, doc_id]
    full = [np.full(n, v) if np.isscalar(v) else np.asarray(v) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v).cast(t) for v, (_, t) in zip(full, _FIELDS, strict=True)], [f for f, _ in _FIELDS])


def _store(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        from pyspark import TaskContext

        files, path = file_system(root)
        files.create_dir(path, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        digest, pack = xxhash.xxh3_128_digest, zstandard.ZstdCompressor(level=1).compress
        for k, batch in enumerate(sliced(batches, "text", BLOCK_BYTES)):
            block = part << 20 | k
            data, offsets = raw_bytes(col(batch, "text"))
            whole = data.tobytes()
            ids = col(batch, "doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            head = np.concatenate(([len(ids)], offsets, ids, known)).astype("<i8").tobytes()
            with files.open_output_stream(f"{path}/.{block}-{attempt}") as out:
                out.write(pack(head + whole))
            files.move(f"{path}/.{block}-{attempt}", f"{path}/{block}.block")
            yield _table(_BLOCK, np.array([block * 0x9E3779B97F4A7C15 & (1 << 63) - 1]), 0, 0, block, 0, np.array([0]), 0, 0)
            order = np.where(known, ids, _NULL_ID)
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for d in np.flatnonzero(np.diff(offsets) >= WINDOW).tolist():
                begin, end = int(offsets[d]), int(offsets[d + 1])
                at, key = anchors(data[begin:end])
                n = end - begin
                around = b"".join([digest(whole[max(begin, begin + p - REACH) : min(end, begin + p + WINDOW)], min(p, REACH)) for p in at.tolist()])
                ctx, more = np.frombuffer(around, "<i8").reshape(-1, 2).T
                for column, value in zip(cols, (key, ctx, more, np.full(len(at), d), at, np.minimum(WINDOW, n - at), np.full(len(at), order[d])), strict=True):
                    column.append(value)
            if not cols[0]:
                continue
            key, ctx, more, doc, a, b, doc_id = (np.concatenate(c) for c in cols)
            sort = np.lexsort((a, doc, doc_id, more, ctx, key))
            key, ctx, more, doc, a, b, doc_id = (x[sort] for x in (key, ctx, more, doc, a, b, doc_id))
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]) | (more[1:] != more[:-1])
            own = key[first]
            kind = np.full(len(own), _ANCHOR, np.int8)
            alike = own[1:] == own[:-1]
            kind[1:][alike] = kind[:-1][alike] = _SPREAD
            yield _table(kind, own, *(x if np.isscalar(x) else x[first] for x in (ctx, more, block, doc, a, b, doc_id)))
            marked = np.unique(own[1:][alike])
            yield _table(_MARK, marked, _NULL_ID, 0, block, 0, np.zeros(len(marked), np.int64), 0, 0)
            s = ~first
            yield _table(_COVER, key[s] ^ np.uint64(block), 0, 0, block, doc[s], *_span(a[s], b[s]), 0)

    return run


def _span(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all WINDOW-byte strings of the text that hold the anchor at a; b: bytes from a on, WINDOW at most."""
    return a - np.minimum(a, REACH), a + b


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, ctx, more, order: covers for repeats, fetches for the first of differing surroundings.

    A mark stands before the other rows of its key and makes them several.
    """
    last: tuple[int, int, int] | None = None  # key, ctx, more of the row before
    held: pa.RecordBatch | None = None  # the key's only representative so far, not yet sent
    held_key, sent = None, False  # sent: the key before has several, all sent
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = col(batch, "kind").to_numpy()
        other = (kind == _COVER) | (kind == _BLOCK)
        if other.any():
            yield batch.filter(pa.array(other))
            batch, kind = batch.filter(pa.array(~other)), kind[~other]
            if not batch.num_rows:
                continue
        key, ctx, more = (col(batch, c).to_numpy() for c in ("key", "ctx", "more"))
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]) | (more[1:] != more[:-1])
        if last == (key[0], ctx[0], more[0]):
            first[0] = False
        last = (key[-1], ctx[-1], more[-1])
        again = ~first & (kind != _MARK)
        if again.any():
            r = batch.filter(pa.array(again))
            start, end = _span(col(r, "a").to_numpy(), col(r, "b").to_numpy())
            yield _table(_COVER, 0, 0, 0, col(r, "block").to_numpy(), col(r, "doc").to_numpy(), start, end, 0)
        reps = batch.filter(pa.array(first))
        if not reps.num_rows:
            continue
        key = col(reps, "key").to_numpy()
        if held is not None and held_key == key[0] and not sent:
            reps = pa.Table.from_batches([held, reps]).combine_chunks().to_batches()[0]
            key = col(reps, "key").to_numpy()
        kind = col(reps, "kind").to_numpy()
        several = kind == _SPREAD
        several[1:] |= key[1:] == key[:-1]
        several[:-1] |= key[1:] == key[:-1]
        if sent and held_key == key[0]:
            several |= key == key[0]
        wanted = several & (kind != _MARK)
        if wanted.any():
            r = reps.filter(pa.array(wanted))
            yield r.set_column(0, "kind", pa.array(np.full(r.num_rows, _FETCH, np.int8)))
        held, held_key, sent = reps.slice(reps.num_rows - 1), key[-1], bool(several[-1])
    give_back()


class _Blocks:
    """Reads stored blocks, one at a time."""

    def __init__(self, root: str):
        import zstandard

        self.files, self.path = file_system(root)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def read(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(offsets, doc_ids, whether not null, text)."""
        with self.files.open_input_stream(f"{self.path}/{block}.block") as f:
            data = self.unpack(f.read())
        n = int(np.frombuffer(data, "<i8", 1)[0])
        head = np.frombuffer(data, "<i8", 3 * n + 2)
        return head[1 : n + 2], head[n + 2 : 2 * n + 2], head[2 * n + 2 :] != 0, data[8 * (3 * n + 2) :]


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(x)], strict=True))


def _fetch(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, now, text, offsets = _Blocks(root), None, b"", None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, doc, a, b = (col(batch, c).to_numpy() for c in ("block", "doc", "a", "b"))
            out = np.zeros((batch.num_rows, REACH + WINDOW), np.uint8)
            for i, j in _runs(block):
                if block[i] != now:
                    now = block[i]
                    offsets, _, _, text = blocks.read(int(now))
                    data = np.frombuffer(text, np.uint8)
                place = offsets[doc[i:j]] + a[i:j]
                at = place[:, None] + np.arange(-REACH, WINDOW)
                inside = (at >= offsets[doc[i:j]][:, None]) & (at < (place + b[i:j])[:, None])
                out[i:j] = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0)
            ctx = pa.FixedSizeBinaryArray.from_buffers(pa.binary(REACH + WINDOW), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
            ends = [pa.array(np.full(len(out), x, np.int32)) for x in (0, REACH)]
            yield pa.RecordBatch.from_arrays([*(col(batch, c) for c in ("key", "block", "doc", "a", "b", "doc_id")), ctx, *ends], ["key", "block", "doc", "a", "b", "doc_id", "bytes", "lo", "hi"])
        give_back()

    return run


def _symbols(flat: np.ndarray, at: np.ndarray, n: int = 8) -> np.ndarray:
    """The n bytes at each place as one number in their order."""
    if n == 8 and len(flat) >= 8:
        return np.ndarray(len(flat) - 7, ">u8", flat, strides=(1,))[at].astype(np.uint64)
    x = np.zeros(len(at), np.uint64)
    for i in range(n):
        x = (x << np.uint64(8)) | flat[at + i]
    return x


def _regrouped(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers from 0 on, begins, counts) of groups whose members stand together."""
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begins, len(group)))
    return np.repeat(np.arange(len(begins)), counts), begins, counts


def multikey_sort(flat: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int = SHALLOW, few: int = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes at ``at`` that share a prefix with another of their group: (indices into at, new groups, bytes shared).

    Three-way multikey quicksort of all groups at once. In a round each group takes the median of three of its
    symbols as pivot and falls into the smaller, the equal and the larger; the equal go on with the next symbol. A
    group of one is dropped. A group leaves once it shares ``depth`` bytes and has ``few`` members at most, or shares WINDOW bytes.
    """
    live, reached = np.arange(len(at)), np.zeros(len(at), np.int64)
    done: list[np.ndarray] = []
    names: list[np.ndarray] = []
    shared: list[np.ndarray] = []
    named = 0
    flat = np.append(flat, np.zeros(8, np.uint8))
    while True:
        group, begins, counts = _regrouped(group)
        alone = counts[group] == 1 if len(group) else np.zeros(0, bool)
        deep = ~alone & (((reached >= depth) & (counts[group] <= few)) | (reached >= WINDOW)) if len(group) else alone
        if deep.any():
            number, _, _ = _regrouped(group[deep])
            done.append(live[deep])
            names.append(number + named)
            shared.append(reached[deep])
            named += int(number[-1]) + 1
        left = ~alone & ~deep
        live, reached, group = live[left], reached[left], group[left]
        if not len(live):
            break
        group, begins, counts = _regrouped(group)
        symbol = _symbols(flat, at[live] + reached)
        if WINDOW % 8:  # the last symbol is shorter
            symbol = np.where(reached + 8 > WINDOW, symbol >> np.uint64(64 - 8 * (WINDOW % 8)), symbol)
        three = np.sort(np.stack([symbol[begins], symbol[begins + counts // 2], symbol[begins + counts - 1]]), axis=0)
        pivot = three[1][group]
        side = 1 + (symbol > pivot).astype(np.int64) - (symbol < pivot)
        # places by counting: smaller, equal, larger within each group, in the order they stand
        place = np.zeros(len(live), np.int64)
        base = begins.copy()
        for s in range(3):
            held = side == s
            upto = np.concatenate(([0], np.cumsum(held)))
            place += np.where(held, base[group] + upto[:-1] - upto[begins][group], 0)
            base += upto[begins + counts] - upto[begins]
        order = np.empty(len(live), np.int64)
        order[place] = np.arange(len(live))
        live, reached, group = live[order], (reached + 8 * (side == 1))[order], (3 * group + side)[order]
    return (np.concatenate(done), np.concatenate(names), np.concatenate(shared)) if done else (live, group, reached)


def _first_difference(flat: np.ndarray, a: np.ndarray, b: np.ndarray, known: int) -> np.ndarray:
    """The first bit in which the WINDOW bytes at a and at b, of which ``known`` are equal, differ; 8 * WINDOW if they don't."""
    out = np.full(len(a), 8 * WINDOW)
    open_ = np.arange(len(a))
    for depth in range(known, WINDOW, 8):
        size = min(8, WINDOW - depth)
        differ = _symbols(flat, a[open_] + depth, size) ^ _symbols(flat, b[open_] + depth, size)
        found = np.flatnonzero(differ)
        high = np.frexp((differ[found] >> np.uint64(32)).astype(np.float64))[1] + 32  # bits up to the highest, exact below 2**53
        low = np.frexp((differ[found] & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        out[open_[found]] = 8 * depth + 8 * size - np.where(differ[found] >> np.uint64(32), high, low)
        open_ = open_[differ == 0]
        if not len(open_):
            break
    return out


def _bit(flat: np.ndarray, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (flat[at + (bit >> 3)] >> (7 - (bit & 7)).astype(np.uint8)) & 1


def blind_tries(flat: np.ndarray, at: np.ndarray, group: np.ndarray, known: int = 0) -> np.ndarray:
    """Of each suffix the index of the first in its group that shares WINDOW bytes with it; all of a group share ``known``.

    A blind trie for each group, of all groups at once: nodes hold nothing but the bit at which their members part. The
    next suffix of each group walks down by those bits alone, without comparing, is compared once with the leaf it
    ends at, and gets a node at the first difference, on the path where that belongs; equal ones get none.
    """
    n = len(at)
    group, begins, counts = _regrouped(group)
    root = ~begins  # ~i: the leaf of suffix i; else a node, by the suffix that made it
    bit, child, first = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.arange(n)
    by_size = np.argsort(-counts, kind="stable")
    sizes = -counts[by_size]
    for k in range(1, int(counts.max(initial=0))):
        g = by_size[: np.searchsorted(sizes, -k)]  # of more than k members
        own = begins[g] + k
        node = root[g]
        walking = np.flatnonzero(node >= 0)
        while len(walking):
            down = node[walking]
            node[walking] = child[down, _bit(flat, at[own[walking]], bit[down])]
            walking = walking[node[walking] >= 0]
        parts = _first_difference(flat, at[own], at[~node], known)
        same = parts == 8 * WINDOW
        first[own[same]] = ~node[same]
        g, own, parts = g[~same], own[~same], parts[~same]
        node, above, turn = root[g], np.full(len(g), -1), np.zeros(len(g), np.int64)
        walking = np.arange(len(g))
        while len(walking := walking[node[walking] >= 0]) and len(walking := walking[bit[node[walking]] < parts[walking]]):
            above[walking] = node[walking]
            turn[walking] = _bit(flat, at[own[walking]], bit[node[walking]])
            node[walking] = child[node[walking], turn[walking]]
        side = _bit(flat, at[own], parts)
        bit[own] = parts
        child[own, side], child[own, 1 - side] = ~own, node
        top = above < 0
        root[g[top]] = own[top]
        child[above[~top], turn[~top]] = own[~top]
    return first


def equal_suffixes(flat: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``flat`` at ``at`` that share their first WINDOW bytes with another of their group: (indices into at, class).

    Deep-shallow sorting; members of a group stand together.
    """
    live, group, shared = multikey_sort(flat, at, group)
    _, begins, counts = _regrouped(group)
    first = np.repeat(begins, counts)
    few = np.flatnonzero(shared < WINDOW)
    first[few] = few[blind_tries(flat, at[live[few]], group[few], SHALLOW)]
    several = np.zeros(len(live), bool)
    again = first != np.arange(len(live))
    several[again] = several[first[again]] = True
    return live[several], first[several]


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row for both halves of its distances, with a key of the bytes that all strings of the half have in common."""
    import xxhash

    for batch in batches:
        key, a, b, lo, hi = (col(batch, c).to_numpy().astype(np.int64) for c in ("key", "a", "b", "lo", "hi"))
        around = col(batch, "bytes").to_pylist()
        mid = (lo + hi) // 2
        for low, high in ((lo, mid), (mid + 1, hi)):
            some = np.flatnonzero((low <= high) & (low <= a) & (WINDOW - high <= b))
            made = [
                xxhash.xxh3_64_intdigest(around[i][REACH - l : REACH + WINDOW - h], (int(k) ^ (l << 7 | h) * 0x9E3779B97F4A7C15) & _U64)
                for i, k, l, h in zip(some.tolist(), key[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True)
            ]
            part = batch.take(pa.array(some))
            for name, value in (("key", np.array(made, np.uint64).view(np.int64)), ("lo", low[some]), ("hi", high[some])):
                at = part.schema.get_field_index(name)
                part = part.set_column(at, name, pa.array(value).cast(part.schema.field(at).type))
            yield part


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and order: covers for the suffixes that occur earlier."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = col(batch, "key").to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        same = bool(held) and col(held[-1], "key")[-1].as_py() == key[0]
        if n * (REACH + 1) >= SORTED_AT_ONCE and not same:
            yield _repeats(held)
            held, n = [], 0
        if cut and (n + cut) * (REACH + 1) >= SORTED_AT_ONCE:
            yield _repeats([*held, batch.slice(0, cut)])
            held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield _repeats(held)
    give_back()


def _may_repeat(flat: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row and distance low <= r <= high whether its string can be another row's of that key.

    All strings of NEAR neighbouring distances hold the same WINDOW - NEAR bytes and more. Where no other row of the key has
    those, told by a hash, none of them repeats.
    """
    around = flat.reshape(len(key), REACH + WINDOW)
    may = np.zeros((REACH + 1, len(key)), bool)
    for lo in range(0, REACH + 1, NEAR):
        hi = min(lo + NEAR - 1, REACH)
        some = np.flatnonzero(np.maximum(low, lo) <= np.minimum(high, hi))
        x = around[some, REACH - lo : REACH - lo + (WINDOW - NEAR) // 8 * 8].copy().view(np.uint64)
        x *= np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        h = x.sum(axis=1, dtype=np.uint64) ^ (key[some].view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        order = np.argsort(h)
        alike = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        may[lo : hi + 1, some[order[np.concatenate((alike, alike + 1))]]] = True
    r = np.arange(REACH + 1)[:, None]
    return may & (low <= r) & (r <= high)


def _repeats(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    key, block, doc, a, b, doc_id, lo, hi = (col(t, c).to_numpy().astype(np.int64) for c in ("key", "block", "doc", "a", "b", "doc_id", "lo", "hi"))
    flat, _ = _binary(col(t, "bytes"))
    n, width = t.num_rows, REACH + WINDOW
    anchor, _, _ = _regrouped(key)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((a, doc, block, doc_id))] = np.arange(n)
    # suffixes start ``r`` before the anchor: lo <= r <= back, WINDOW - r <= forth
    low, high = np.maximum(lo, WINDOW - b), np.minimum(hi, a)
    found, may = np.zeros((n, REACH + 1), bool), _may_repeat(flat, key, low, high)
    step = max(1, SORTED_AT_ONCE // n)
    for begin in range(0, REACH + 1, step):
        r, row = np.nonzero(may[begin : begin + step])
        r += begin
        live, group = equal_suffixes(flat, row * width + REACH - r, r * n + anchor[row])
        if len(live):  # all but the earliest of each class; one place can stand in several rows
            order = np.lexsort((-r[live], rank[row[live]], group))
            live, group = live[order], group[order]
            begins = np.append(True, group[1:] != group[:-1])
            first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            x, f = row[live], row[live[first]]
            place, earliest = a[x] - r[live], a[f] - r[live[first]]
            later = (doc_id[x] != doc_id[f]) | (block[x] != block[f]) | (doc[x] != doc[f]) | (place != earliest)
            found[x[later], r[live][later]] = True
    row, r = np.nonzero(found)
    # neighbouring starts of a row make one span
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (r[1:] != r[:-1] + 1)
    last = np.append(new[1:], True) if len(row) else new
    x = row[new]
    return _table(_COVER, 0, 0, 0, block[x], doc[x], a[x] - r[last], a[x] - r[new] + WINDOW, 0)


def _stay_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a single distance sorted by key and order, the string told by the key: covers for all but the first of each."""
    now, seen = None, set()
    for batch in batches:
        key, lo = col(batch, "key").to_pylist(), col(batch, "lo").to_pylist()
        again = np.zeros(batch.num_rows, bool)
        for i, (k, r, around) in enumerate(zip(key, lo, col(batch, "bytes").to_pylist(), strict=True)):
            if k != now:
                now, seen = k, set()
            string = around[REACH - r : REACH - r + WINDOW]
            again[i] = string in seen
            seen.add(string)  # one, but for a collision of keys
        if again.any():
            r = batch.filter(pa.array(again))
            start = col(r, "a").to_numpy() - col(r, "lo").to_numpy()
            yield _table(_COVER, 0, 0, 0, col(r, "block").to_numpy(), col(r, "doc").to_numpy(), start, start + WINDOW, 0)


def _dealt(fetched: DataFrame, fetch: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows in which a key has MOST_ROWS at most, and rows of a single distance, if any: (rows to sort, rows that are told)."""
    hot = materialize(fetch.groupBy("key").count().where(F.col("count") > MOST_ROWS).select("key"))
    if not hot.limit(1).count():
        return fetched, None
    rows = materialize(fetched)
    out, level, width = rows.join(hot, "key", "left_anti"), rows.join(hot, "key", "left_semi"), REACH + 1
    while True:
        level, width = materialize(level.mapInArrow(_deal, level.schema)), -(-width // 2)
        if width == 1:
            return out, level
        hot = materialize(level.groupBy("key").count().where(F.col("count") > MOST_ROWS).select("key"))
        if not hot.limit(1).count():
            return out.unionByName(level), None
        out, level = out.unionByName(level.join(hot, "key", "left_anti")), level.join(hot, "key", "left_semi")


def _binary(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _finish(root: str, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * with_text
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    def block_rows(blocks: _Blocks, block: int, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        offsets, ids, known, text = blocks.read(block)
        change = np.zeros(len(text) + 1, np.int32)
        np.add.at(change, offsets[doc] + a, 1)
        np.add.at(change, offsets[doc] + b, -1)
        gone = np.cumsum(change[:-1]) > 0
        before = np.concatenate(([0], np.cumsum(gone)))
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(text)]
        starts[inner] = gone[inner]
        spans = np.concatenate(([0], np.cumsum(starts)))
        data = np.frombuffer(text, np.uint8)
        left = data[~gone].tobytes()
        kept = offsets - before[offsets]
        rows = [left[i:j] for i, j in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
        out = [pa.array(ids, mask=~known), pa.array(np.diff(offsets)), pa.array(np.diff(before[offsets])), pa.array(np.diff(spans[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in rows])]
        if with_text:
            out.append(pa.array([x.decode("utf-8", "replace") for x in rows], pa.string()))
        return pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(out, kinds, strict=False)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, now, parts = _Blocks(root), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, kind = col(batch, "block").to_numpy(), col(batch, "kind").to_numpy()
            doc, a, b = (col(batch, c).to_numpy() for c in ("doc", "a", "b"))
            for i, j in _runs(block):
                if block[i] != now and now is not None:
                    yield block_rows(blocks, now, *(np.concatenate(x) for x in zip(*parts, strict=True)))
                if block[i] != now:
                    now, parts = int(block[i]), []
                cover = kind[i:j] == _COVER
                parts.append((doc[i:j][cover], a[i:j][cover], b[i:j][cover]))
        if now is not None:
            yield block_rows(blocks, now, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove from each text every byte covered by a WINDOW-byte string that also starts earlier.

    Earlier: in a document with a smaller doc_id (null first; rows with an equal doc_id in the order
    they are read), or before in the same one. Strings don't cross documents and are judged on the input.
    One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and text: what is left,
    broken characters replaced). Null text counts as empty, and texts shorter than WINDOW stay whole.
    An empty table gives no rows, and a long text is a block of its own. ``docs`` must give the same rows when read again, as a
    table or checkpoint does; its other columns are not read. Blocks stay in the shared folder, as the result is read from them.
    """
    root = work_dir(docs.sparkSession)
    rows = texts(docs)
    spread = F.when(F.col("kind") == _SPREAD, F.col("ctx")).otherwise(F.lit(0))
    order = ["doc_id", "block", "doc", "a"]
    sent = rows.mapInArrow(_store(root), _SCHEMA).repartition(F.col("key"), spread).sortWithinPartitions("key", "ctx", "more", *order)
    met = materialize(sent.mapInArrow(_meet, _SCHEMA).select("kind", "key", "block", "doc", "a", "b", "doc_id"))
    fetch = met.where(F.col("kind") == _FETCH)
    fields = "key bigint, block bigint, doc int, a int, b int, doc_id bigint, bytes binary, lo int, hi int"
    fetched = fetch.repartition("block").sortWithinPartitions("block", "doc", "a").mapInArrow(_fetch(root), fields)
    rest, told = _dealt(fetched, fetch)
    covers = met.where(F.col("kind") != _FETCH).select("kind", "block", "doc", "a", "b")
    for part, work in ((rest, _sort), (told, _stay_first)):
        if part is not None:
            covers = covers.unionByName(part.repartition("key").sortWithinPartitions("key", *order).mapInArrow(work, _SCHEMA).select("kind", "block", "doc", "a", "b"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * with_text
    return covers.repartition("block").sortWithinPartitions("block", "doc").mapInArrow(_finish(root, with_text), schema)
