import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeweave.llm import similar
from tomeweave.llm._text import raw_bytes

from .conftest import LONG, ODD
from .test_dedup import lower

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_groups(rows, least=0.8):
    """Smallest id of each row's component over all pairs of at least this similarity."""
    sets = [(d, shingles(t)) for d, t in rows]
    label = {d: d for d, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (d, a), (e, b) in combinations(sets, 2):
        if jaccard(a, b) >= least:
            x, y = find(d), find(e)
            label[max(x, y)] = min(x, y)
    return {d: find(d) for d in label}


def test_shingle_sets_and_fingerprints():
    import pyarrow as pa

    texts = [t for _, t, _, _ in ODD] + ["a b c d e", "A b c d e a b c d e", LONG[:5000]]
    hashes, bounds = similar.shingles_of(*raw_bytes(pa.array(texts)))
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    assert len(np.unique(hashes)) == len(frozenset().union(*map(shingles, texts)))
    got = similar.wide_fingerprints_of(hashes, bounds)
    for d, fp in enumerate(got):
        h = hashes[bounds[d] : bounds[d + 1]]
        if len(h):
            bits = np.unpackbits(similar._finish(h[:, None] * similar._ODD[None, :]).view(np.uint8), axis=1, bitorder="little")
            assert (np.unpackbits(fp, bitorder="little") == (2 * bits.sum(axis=0, dtype=np.int64) + bits[0] > len(h))).all()
        else:
            assert not fp.any()


def test_odd_rows_and_empty(odd, none):
    got = {r.doc_id: r.component_id for r in similar.similar_documents(odd).collect()}
    assert got == brute_groups([(d, t) for d, t, _, _ in ODD if d is not None])
    kept = similar.keep_one_similar(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, None, None, 6, 7, 8, -9], key=str)
    assert similar.similar_documents(none).collect() == [] and similar.keep_one_similar(none).collect() == []


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("members", [1024, 48])
def test_planted_copies(spark, monkeypatch, members):
    """Small edits are found, also where nodes are dealt in pieces; texts below the similarity stay apart."""
    monkeypatch.setattr(similar, "NODE_MEMBERS", members)
    rng = random.Random(7)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(1000 * g + i, edited(base, i and 4, rng)) for i in range(4)]
        rows.append((1000 * g + 500, edited(base, 30, rng)))  # similarity about 0.4
    base = [f"v{rng.randrange(5000)}" for _ in range(200)]
    rows += [(10**6 + i, edited(base, i and 2, rng)) for i in range(300)]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_groups(rows)


def test_table(table):
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect() if r.doc_id is not None]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(table).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("limit", [100, 224, 500])
def test_wide_index_finds_all(limit):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, (6, 16), dtype=np.uint64)
    v = base[rng.integers(0, 6, 300)]
    for _ in range(80):  # up to so many bits from their base
        v[np.arange(300), rng.integers(0, 16, 300)] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    index = similar.WideGrayIndex(v)
    found = {(int(index.order[a]), int(index.order[b])): int(d) for i, j, bits in index.pairs(limit) for a, b, d in zip(i, j, bits, strict=True)}
    want = {}
    for a, b in combinations(range(300), 2):
        d = int(np.bitwise_count(v[a] ^ v[b]).sum())
        if d <= limit:
            want[a, b] = d
    assert {tuple(sorted(k)): d for k, d in found.items()} == want and len(found) == len(want)


@pytest.mark.parametrize("most", [4, 25, 1000])
def test_all_parts_of_a_key_meet(spark, most):
    """A part with most of a key's rows, some middling parts and many single ones; cells stay small."""
    rng = random.Random(2)
    rows = [(k, p, 1000 * k + i) for k in range(3) for i, p in enumerate([0] * 150 * k + [1] * 20 + [2] * 9 + list(range(10, 60)))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "key bigint, part bigint, doc_id bigint")
    cells = {}
    for r in similar._dealt(frame, "key", "part", F.lit(1), most).collect():
        cells.setdefault((r.key, r.cell), []).append((r.part, r.doc_id))
    met = {(a, b) for c in cells.values() for (p, a), (q, b) in combinations(sorted(c, key=lambda x: x[1]), 2) if p != q}
    want = {(a, b) if a < b else (b, a) for (k, p, a), (h, q, b) in combinations(rows, 2) if k == h and p != q}
    assert met == want
    assert max(map(len, cells.values())) <= 4 * most + 20


def test_candidates_connect():
    i, j, d = np.array([1, 2, 3, 5, 4, 5]), np.array([0, 1, 0, 4, 0, 0]), np.array([150, 151, 160, 140, 170, 175])
    assert set(similar.candidates(np.arange(6), i, j, d).tolist()) >= {0, 1, 2, 3, 4}


def groups_of(spark, rows):
    return {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def lost(rows, got):
    """Pairs at or above the similarity that ended up apart."""
    sets = [(d, shingles(t)) for d, t in rows]
    return [(d, e) for (d, a), (e, b) in combinations(sets, 2) if got[d] != got[e] and jaccard(a, b) >= 0.8]


def test_pieces_of_hot_patterns_meet(spark, monkeypatch):
    """Pairs above the similarity in a family of one template mostly below it, with patterns and prefix shingles dealt in pieces."""
    monkeypatch.setattr(similar, "NODE_MEMBERS", 32)
    monkeypatch.setattr(similar, "FAMILY_SHINGLES", 4000)
    rng = random.Random(3)
    base = [f"t{k}" for k in range(300)]
    rows = []
    for g in range(150):
        page = edited(base, 5, rng).split()
        rows += [(2 * g, " ".join(page)), (2 * g + 1, edited(page, 5, rng))]
    assert lost(rows, groups_of(spark, rows)) == []


def test_links_are_held_against_texts(spark):
    """A family whose pairs are all a little below the similarity stays apart, however few bits some of them differ in."""
    rng = random.Random(11)
    base = [f"t{k}" for k in range(300)]
    rows = [(i, edited(base, 4, rng)) for i in range(250)]
    assert groups_of(spark, rows) == brute_groups(rows)


def test_failed_candidates_are_replaced(spark):
    """Variants on either side of the similarity: a closest pair by bits is often not the most similar."""
    rng = random.Random(5)
    rows = []
    for g in range(40):
        base = [f"g{g}_{k}" for k in range(300)]
        rows += [(100 * g + i, edited(base, 3 if i in (5, 9) else 4, rng)) for i in range(14)]
    assert lost(rows, groups_of(spark, rows)) == []


def test_refiled_members_meet(spark, monkeypatch):
    """Pairs just above the similarity in patterns that are filed anew several times."""
    monkeypatch.setattr(similar, "NODE_MEMBERS", 4)
    rng = random.Random(13)
    base = [f"t{k}" for k in range(300)]
    rows = []
    for g in range(150):
        page = edited(base, 20, rng).split()
        rows += [(2 * g, " ".join(page)), (2 * g + 1, edited(page, 6, rng))]
    assert lost(rows, groups_of(spark, rows)) == []


def test_short_texts(spark):
    """Texts of 8 and 9 words share 4 of 5 shingles; 12 and 15 shingles are at the similarity too."""
    rng = random.Random(17)
    rows = []
    for g in range(120):
        words = [f"s{rng.randrange(10**6)}" for _ in range(16 if g % 2 else 8)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words + [f"more{g}_{k}" for k in range(3 if g % 2 else 1)]))]
    assert groups_of(spark, rows) == brute_groups(rows)
