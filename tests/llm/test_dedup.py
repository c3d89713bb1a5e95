import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tomeweave.llm import simhash, suffix_dedup
from tomeweave.llm.exact_dedup import LEAST, chunk_ends, drop_exact, exact_dedup
from tomeweave.llm.suffix_dedup import equal_suffixes, remove_repeats

from .conftest import LONG, ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_fingerprint(text):
    w = WORDS.findall(lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """component_id by row from pairs of fingerprints, each compared with all."""
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                label[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [f"{f:016x}" for f in fps], [low.get(find(i)) for i in range(len(rows))]


def test_simhash_odd_rows(odd, none):
    rows = [(d, t) for d, t, _, _ in ODD]
    fps, components = brute_components(rows)
    got = sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str)
    assert got == sorted(((d, f, c) for (d, _), f, c in zip(rows, fps, components, strict=True)), key=str)
    assert simhash.near_duplicates(none).collect() == []


def test_simhash_table(table):
    rows = [(r.doc_id, r.text) for r in table.collect()]
    fps, components = brute_components(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect()}
    assert got == {d: (f, c) for (d, _), f, c in zip(rows, fps, components, strict=True)}
    kept = {r.doc_id for r in simhash.keep_one(table).collect()}
    assert kept == set(components)


@pytest.mark.parametrize("members", [2048, 40])
def test_star_edges_connect_what_links_connect(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "NODE_MEMBERS", members)
    rng = random.Random(4)
    values = set()
    for _ in range(30):
        v = rng.getrandbits(64) & ~((1 << 40) - 1)
        for _ in range(12):
            values.add(v)
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.star_edges(spark.createDataFrame(signed, "fp bigint")).collect()
    parent = {v[0]: v[0] for v in signed}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for e in edges:
        parent[find(parent, e.src)] = find(parent, e.dst)
    want = {v[0]: v[0] for v in signed}
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2:
                want[find(want, signed[i][0])] = find(want, signed[j][0])
    same = lambda p: {frozenset(x for x in p if find(p, x) == r) for r in {find(p, x) for x in p}}
    assert same(parent) == same(want)


def test_gray_index_finds_all():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 12, 700, dtype=np.uint64) << np.uint64(7))
    index = simhash.GrayIndex(values)
    for distance in (0, 2, 5):
        q, m = index.search(values[:50], distance)
        want = {(i, int(v)) for i in range(50) for v in values if int(values[i] ^ v).bit_count() <= distance}
        assert {(int(i), int(index.values[j])) for i, j in zip(q, m, strict=True)} == want


def test_exact_odd_rows(odd, none):
    got = exact_dedup(odd).collect()
    assert len(got) == len(ODD)
    texts = {}
    for d, t, _, _ in ODD:
        texts.setdefault(t or "", []).append(d)
    for r in got:
        group = next(g for t, g in texts.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [d for d in group if d is not None]
        assert r.group_size == len(group) and r.keep_id == (max(known) if known else None)
    assert sum(r.kept for r in got) == len(texts)
    kept = drop_exact(odd)
    assert kept.columns == odd.columns and kept.count() == len(texts)
    assert exact_dedup(none).collect() == [] and drop_exact(none).collect() == []


def test_chunks_depend_on_content():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 300_000, dtype=np.uint8)
    ends = chunk_ends(data)
    assert ends[-1] == len(data) and all(b > a for a, b in zip([0, *ends], ends, strict=False))
    moved = np.concatenate((rng.integers(0, 256, 777, dtype=np.uint8), data))
    shared = {e + 777 for e in ends} & set(chunk_ends(moved))
    assert len(shared) > 0.8 * len(ends)
    assert chunk_ends(data[:LEAST]) == [LEAST] and chunk_ends(data[:0]) == [0]
    assert max(np.diff([0, *chunk_ends(np.zeros(10**6, np.uint8))])) <= 65536


def brute_repeats(rows):
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        gone = gone[:-1]
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats_odd_rows(odd, none):
    order = sorted(((d, t) for d, t, _, _ in ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    got = remove_repeats(odd, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute_repeats(order), key=str)
    assert all(len(r.text.encode()) == r.n_bytes - r.n_removed for r in got)
    assert remove_repeats(none).collect() == []


@pytest.mark.parametrize("at_once", [1 << 20, 4000])
def test_repeats_brute(spark, monkeypatch, at_once):
    monkeypatch.setattr(suffix_dedup, "SORTED_AT_ONCE", at_once)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcd é") for _ in range(400)) for _ in range(5)]
    cut = lambda s, a: s[a : a + rng.randint(50, 260)]
    rows = [(i, "".join(cut(rng.choice(base), rng.randint(0, 200)) for _ in range(rng.randint(0, 5)))) for i in range(120)]
    rows += [(200, "ab" * 300), (201, "a" * 99), (202, "a" * 100), (203, "a" * 150), (204, base[0]), (205, base[0])]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    docs = spark.createDataFrame(shuffled, "doc_id bigint, text string").repartition(4).checkpoint()
    assert sorted(map(tuple, remove_repeats(docs).collect())) == sorted(brute_repeats(rows))


def test_repeats_table(table):
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    assert sorted(map(tuple, remove_repeats(table).collect())) == brute_repeats(rows)


def grouped_suffixes(rng, n_groups):
    flat = np.concatenate([rng.integers(97, 99, 300), np.tile(rng.integers(97, 120, 150), 3), rng.integers(97, 98, 300)]).astype(np.uint8)
    at = np.concatenate([rng.permutation(len(flat) - 100), rng.permutation(len(flat) - 100)])  # places occur twice
    group = np.sort(rng.integers(0, n_groups, len(at)))
    return flat, at, group


@pytest.mark.parametrize("n_groups", [1, 7, 400])
def test_equal_suffixes(n_groups):
    flat, at, group = grouped_suffixes(np.random.default_rng(3), n_groups)
    live, cls = equal_suffixes(flat, at, group)
    classes = {}
    for k, (i, g) in enumerate(zip(at.tolist(), group.tolist(), strict=True)):
        classes.setdefault((g, flat[i : i + 100].tobytes()), set()).add(k)
    got = {frozenset(live[cls == c].tolist()) for c in set(cls.tolist())}
    assert got == {frozenset(c) for c in classes.values() if len(c) > 1}


@pytest.mark.parametrize("n_groups", [1, 7, 400])
def test_multikey_sort_and_blind_tries(n_groups):
    flat, at, group = grouped_suffixes(np.random.default_rng(5), n_groups)
    live, new, shared = suffix_dedup.multikey_sort(flat, at, group, few=10**6)
    assert (shared == 24).all()
    classes = {}
    for k, (i, g) in enumerate(zip(at.tolist(), group.tolist(), strict=True)):
        classes.setdefault((g, flat[i : i + 24].tobytes()), set()).add(k)
    assert {frozenset(live[new == c].tolist()) for c in set(new.tolist())} == {frozenset(c) for c in classes.values() if len(c) > 1}
    live, new, shared = suffix_dedup.multikey_sort(flat, at, group, few=0)
    classes = {}
    for k, (i, g) in enumerate(zip(at.tolist(), group.tolist(), strict=True)):
        classes.setdefault((g, flat[i : i + 100].tobytes()), set()).add(k)
    assert {frozenset(live[new == c].tolist()) for c in set(new.tolist())} == {frozenset(c) for c in classes.values() if len(c) > 1}
    first, seen = suffix_dedup.blind_tries(flat, at, group), {}
    assert first.tolist() == [seen.setdefault((g, flat[i : i + 100].tobytes()), k) for k, (i, g) in enumerate(zip(at.tolist(), group.tolist(), strict=True))]


@pytest.mark.parametrize("most", [8192, 8, 1])
def test_hot_anchor(spark, monkeypatch, most):
    """A line too short for a window, in other surroundings each time, some of them equal; dealt down to single distances."""
    monkeypatch.setattr(suffix_dedup, "MOST_ROWS", most)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    rng = random.Random(8)
    line = "all rights reserved; see the licence for details"  # 48 bytes
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([20, 70])))
    words = [word() for _ in range(6)]
    rows = [(i, f"{rng.choice(words)} {line} {rng.choice(words) if rng.random() < 0.5 else word()}") for i in range(150)]
    rows += [(1000 + i, line * 3) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).checkpoint()
    assert sorted(map(tuple, remove_repeats(docs).collect())) == sorted(brute_repeats(rows))


def test_many_surroundings_in_bounded_memory():
    """10**5 rows of one anchor: dealt until no key has more than MOST_ROWS, then sorted; memory follows MOST_ROWS."""
    import tracemalloc

    import pyarrow as pa

    rng, n = np.random.default_rng(4), 100_000
    around = rng.integers(97, 123, (n, 180), dtype=np.uint8)
    around[:, 80:100] = np.frombuffer(b"the same twenty byte", np.uint8)
    around[n // 2 :, 60:180] = around[: n // 2, 60:180]  # half of them repeat 120 bytes of the others
    fields = {"key": np.zeros(n, np.int64), "block": np.zeros(n, np.int64), "doc": np.arange(n, dtype=np.int32), "a": np.full(n, 80, np.int32), "b": np.full(n, 100, np.int32), "doc_id": np.arange(n), "lo": np.zeros(n, np.int32), "hi": np.full(n, 80, np.int32)}
    rows = pa.table({**fields, "bytes": pa.array([x.tobytes() for x in around], pa.binary())})
    covered = np.zeros(n, np.int64)
    level = rows.to_batches(max_chunksize=10_000)
    tracemalloc.start()
    while level:
        dealt = pa.Table.from_batches(suffix_dedup._deal(iter(level))).sort_by([("key", "ascending"), ("doc_id", "ascending")])
        sizes = dealt.group_by("key").aggregate([("doc_id", "count")])
        hot = sizes.filter(pa.compute.greater(sizes.column("doc_id_count"), suffix_dedup.MOST_ROWS)).column("key").combine_chunks()
        large = pa.compute.is_in(dealt.column("key"), value_set=hot)
        for part in suffix_dedup._sort(iter(dealt.filter(pa.compute.invert(large)).to_batches(max_chunksize=10_000))):
            np.add.at(covered, part.column(5).to_numpy(), part.column(7).to_numpy() - part.column(6).to_numpy())
        level = dealt.filter(large).to_batches(max_chunksize=10_000)
    assert tracemalloc.get_traced_memory()[1] < 600 << 20
    tracemalloc.stop()
    assert not covered[: n // 2].any() and (covered[n // 2 :] >= 120).all()


def test_long_text_is_there():
    assert len(LONG) > 300_000


def test_strings_that_cannot_repeat_are_not_sorted(monkeypatch):
    import pyarrow as pa

    draw, anchor, width = random.Random(7), b"the anchor's 20 byte", suffix_dedup.REACH + suffix_dedup.WINDOW
    rows = [bytes(draw.randbytes(suffix_dedup.REACH)) + anchor + bytes(draw.randbytes(width - suffix_dedup.REACH - 20)) for _ in range(40)]
    at = 33  # two rows share the 100 bytes that begin 33 before the anchor, and so one string
    begin = suffix_dedup.REACH - at
    rows.append(draw.randbytes(begin) + rows[0][begin : begin + 100] + draw.randbytes(width - begin - 100))
    n, sorted_ = len(rows), []
    real = suffix_dedup.equal_suffixes
    monkeypatch.setattr(suffix_dedup, "equal_suffixes", lambda flat, places, group: sorted_.append(len(places)) or real(flat, places, group))
    names = ["key", "block", "doc", "a", "b", "doc_id", "bytes", "lo", "hi"]
    columns = [[5] * n, [0] * n, list(range(n)), [500] * n, [100] * n, list(range(n)), rows, [0] * n, [suffix_dedup.REACH] * n]
    out = suffix_dedup._repeats([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)]).to_pylist()
    assert [(r["doc"], r["a"], r["b"]) for r in out] == [(n - 1, 500 - at, 500 - at + 100)]
    assert sum(sorted_) <= 2 * suffix_dedup.NEAR < 81 * n  # distances of the two rows' range, not all of all rows
