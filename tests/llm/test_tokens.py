import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from tomeweave.llm import packing, token_counts, token_tables
from tomeweave.llm._session import file_system

from .conftest import ODD


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, out, reference, capacity):
    want = Counter()
    for doc, text in rows:
        ids = [*reference(text), 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            want[doc, piece, at, len(ids[at : at + capacity]), crc(ids[at : at + capacity])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [4096, 7])
def test_pack_odd_rows(odd, none, reference, capacity):
    rows = [(d, t) for d, t, _, _ in ODD]
    check_packing(rows, packing.pack(odd, capacity).collect(), reference, capacity)
    assert packing.pack(none).collect() == []


@pytest.mark.parametrize("together", [1 << 16, 1])
def test_pack_table(table, reference, monkeypatch, together):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", together)
    monkeypatch.setattr(packing, "FEWEST", min(256, together + 1))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    out = packing.pack(table, with_ids=True).collect()
    used = check_packing(rows, out, reference, 4096)
    assert used == -(-sum(r.length for r in out) // 4096)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for capacity in (5, 64, 300):
        for _ in range(25):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
            counts = np.bincount(lengths, minlength=capacity + 1)
            plan = packing.best_fit_plan(counts, capacity)
            gaps = []
            for n in sorted(lengths, reverse=True):
                fit = [g for g in range(len(gaps)) if gaps[g] >= n]
                if fit:
                    gaps[min(fit, key=lambda g: gaps[g])] -= n
                else:
                    gaps.append(capacity - n)
            assert plan["n"][0] == len(gaps)
            placed = sorted(zip(plan["length"].tolist(), plan["rank"].tolist(), strict=True))
            assert all(r < counts[n] for n, r in placed)


def test_tables_odd_rows(odd, none, reference):
    manifest = token_tables.write_tables(odd)
    out = token_tables.read_tables(manifest).collect()
    want = Counter((d, len(reference(t)) + 1, crc([*reference(t), 2])) for d, t, _, _ in ODD)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    out.sort(key=lambda r: r.start)
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in out]
    assert keys == sorted(keys)
    assert token_tables.read_tables(token_tables.write_tables(none)).collect() == []
    for doc in (7, 2, 3, None, -9, 12345):
        want = sorted([*reference(t), 2] for d, t, _, _ in ODD if d == doc)
        assert sorted(x.tolist() for x in token_tables.find(manifest, doc)) == want
    found = 0
    for row in manifest.collect():
        files, path = file_system(row.path)
        with files.open_input_file(path) as f:
            reader = token_tables.TableReader(f, f.size())
            value = reader.get(token_tables.encode_key(7))
            found += value is not None and zlib.crc32(value) == crc([*reference(ODD[9][1]), 2])
    assert found == 1


def test_tables_many_files(table, reference):
    out = token_tables.read_tables(token_tables.write_tables(table, file_bytes=20_000)).collect()
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    start, want = 0, []
    for doc, text in rows:
        ids = [*reference(text), 2]
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, out)) == want


def test_table_file():
    rng = random.Random(2)
    rows = {token_tables.encode_key(k, o): rng.randbytes(4 * rng.randint(0, 40)) for k in (None, *rng.sample(range(-(10**9), 10**9), 500)) for o in (0, 1)}
    stream = io.BytesIO()
    writer = token_tables.TableWriter(stream, block_bytes=700)
    for key in sorted(rows):
        writer.add(key, rows[key])
    with pytest.raises(ValueError):
        writer.add(min(rows), b"")
    writer.finish()
    reader = token_tables.TableReader(stream, stream.tell())
    assert list(reader.scan()) == sorted(rows.items()) and len(reader.first) > 10
    assert all(reader.get(k) == v for k, v in rows.items()) and reader.get(token_tables.encode_key(10**10)) is None
    assert [token_tables.decode_key(k)[0] for k in sorted(rows)][:2] == [None, None]
    data = bytearray(stream.getvalue())
    data[20] ^= 1
    with pytest.raises(ValueError):
        list(token_tables.TableReader(io.BytesIO(data), len(data)).scan())
    empty = io.BytesIO()
    token_tables.TableWriter(empty).finish()
    assert list(token_tables.TableReader(empty, empty.tell()).scan()) == []


def test_counts(odd, none, table):
    scores = token_counts.fit_scores(table, rounds=2)
    model = Tokenizer(models.Unigram([("<unk>", -100.0), *scores.items()], 0, False))
    from .test_dedup import WORDS

    def count(text):  # runs of unknown characters are one token there, one each here
        words = WORDS.findall(text or "")
        return len(words), sum(len(model.encode(token_counts.MARK + w).ids) for w in words)

    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(table, scores=scores).collect()}
    assert got == {r.doc_id: count(r.text) for r in table.collect()}
    rows = token_counts.token_counts(odd, scores=scores).collect()
    assert Counter((r.doc_id, r.n_pretokens) for r in rows) == Counter((d, count(t)[0]) for d, t, _, _ in ODD)
    assert token_counts.token_counts(none).collect() == []
    assert token_counts.token_counts(odd).count() == len(ODD)


def test_scores_are_re_estimated_over_all_pretokens(odd):
    """Against plain Viterbi re-estimation over the words one by one."""
    import math

    from .test_dedup import WORDS

    pieces = token_counts.pieces_of()
    words = Counter(token_counts.MARK + w for _, t, _, _ in ODD for w in WORDS.findall(t or ""))
    scores = dict.fromkeys(pieces, -math.log(len(pieces)))
    for _ in range(3):
        seen, unknown = Counter(), min(scores.values()) + token_counts.UNKNOWN
        for word, times in words.items():
            best = [(0.0, 0, ())]  # score, fewest tokens, path; the shorter last piece first
            for end in range(1, len(word) + 1):
                steps = [(best[end - 1][0] + unknown, -best[end - 1][1] - 1, end - 1)]
                steps += [(best[a][0] + scores[word[a:end]], -best[a][1] - 1, a) for a in range(max(0, end - 40), end) if word[a:end] in scores]
                score, n, a = max(steps)
                best.append((score, -n, (*best[a][2], word[a:end])))
            for piece in best[-1][2]:
                seen[piece] += times * (piece in scores)
        total = sum(seen.values()) + len(pieces)
        scores = {p: math.log((seen[p] + 1) / total) for p in pieces}
    assert token_counts.fit_scores(odd, rounds=3) == scores
    assert token_counts.fit_scores(odd.repartition(7), rounds=3) == scores


def test_trie_against_plain_dynamic_programming():
    rng = random.Random(3)
    scores = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 5 for _ in range(40)}
    counter = token_counts.TrieCounter(scores)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(300)})

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            steps = [(best[end - 1][0] + counter.unknown, -best[end - 1][1] - 1)]
            steps += [(best[a][0] + scores[word[a:end]], -best[a][1] - 1) for a in range(end) if word[a:end] in scores]
            s, n = max(steps)
            best.append((s, -n))
        return best[-1][1]

    assert counter.counts(words) == [plain(w) for w in words]
