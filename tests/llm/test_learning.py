from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeweave.llm import language, mixing, quality, toxicity
from tomeweave.llm._sample import held_out

from .conftest import ODD, SCHEMA
from .test_dedup import WORDS


def test_language(odd, none, table):
    model = language.fit(table.where(~held_out(F.col("doc_id"))))
    out = language.predict(table, model).select("*", held_out(F.col("doc_id")).alias("held_out")).collect()
    tested = [r for r in out if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in out)
    rows = language.predict(odd, model)
    assert set(rows.columns) == set(odd.columns) and rows.count() == len(ODD)
    assert {r.lang_pred for r in rows.where("text is null or text in ('', '***### $$$ 123')").collect()} == {"und"}
    assert language.predict(none, model).collect() == []
    assert {r.lang_pred for r in language.predict(odd, language.fit(none)).collect()} == {"und"}


def test_kernel_is_the_presence_kernel():
    presence = language.Presence()
    sets = []
    for text in ("abcab", "bcabx"):
        n = presence.fill(text)
        sets.append(set(np.flatnonzero(presence.map).tolist()))
        grams = {text[i : i + k] for k in range(1, 5) for i in range(len(text) - k + 1)}
        assert n == len(grams)
    assert len(sets[0] & sets[1]) == len({"a", "b", "c", "ab", "bc", "ca", "bca", "cab", "bcab"})


def test_predictions_are_the_kernel_matrix_times_alpha(spark, table):
    """Against kernels by intersection of n-gram sets, one pair at a time, and plain ridge regression."""
    from tomeweave.llm._sample import stratified

    rows = table.where("lang is not null and text is not null and text <> ''").select("doc_id", "text", "lang")
    drawn = stratified(rows, "lang", 12)
    marks = [r.text for r in stratified(drawn, "lang", 4, salt="landmark").collect()]
    seen = drawn.collect()
    presence = language.Presence()

    def grams(text):
        presence.fill(text)
        return set(np.flatnonzero(presence.map).tolist())

    held = [grams(t) for t in marks]
    kernel = lambda texts: np.array([[len(g & m) / np.sqrt(len(g) * len(m)) for m in held] for g in map(grams, texts)])
    languages = sorted({r.lang for r in seen})
    k_nm, k_mm = kernel([r.text for r in seen]), kernel(marks)
    y = np.array([[1.0 if r.lang == x else -1.0 for x in languages] for r in seen])
    alpha = np.linalg.solve(k_nm.T @ k_nm + language.RIDGE * len(seen) * k_mm + 1e-9 * len(seen) * np.eye(len(marks)), k_nm.T @ y)
    tested = rows.limit(40).collect()
    want = kernel([r.text for r in tested]) @ alpha
    share = np.exp(language.STEEP * (want - want.max(axis=1, keepdims=True)))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(rows, language.fit(rows, landmarks=4, fit_rows=12)).collect()}
    for r, w, p in zip(tested, want, share, strict=True):
        assert got[r.doc_id][0] == languages[int(w.argmax())] and abs(got[r.doc_id][1] - p.max() / p.sum()) < 2e-3


def test_number_signs_are_no_letters(spark, table):
    texts = ["½ ②", "² Ⅷ ①", "_ 12", "a 1", "½é"]
    rows = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.lang_pred for r in language.predict(rows, language.fit(table)).collect()}
    assert [found[i] == "und" for i in range(5)] == [not any(c.isalpha() for c in t) for t in texts] == [True, True, True, False, False]


def test_toxicity(spark, odd, none, table):
    try:
        labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
        docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    except Exception:
        pytest.skip("no tables")
    grammar = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = toxicity.score(docs, grammar).join(labels, "doc_id").where(held_out(F.col("doc_id"))).groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in out}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.85
    rows = toxicity.score(odd, grammar)
    assert rows.count() == len(ODD) and rows.where("score between 0 and 1").count() == len(ODD)
    assert toxicity.score(none, grammar).collect() == []
    bare = toxicity.fit(none, labels.limit(0))
    assert toxicity.score(odd, bare).where("predicted = 1").count() in (0, len(ODD))


def test_machine():
    m = toxicity.Machine()
    insult, target, negation, said, end, other = toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORTED, toxicity.END, toxicity.OTHER
    threat, intent, head, link = toxicity.THREAT, toxicity.INTENT, toxicity.HEAD, toxicity.LINK
    run = lambda *c: round(m.run(list(c), [1.0 if x in (insult, threat) else 0.0 for x in c])[1], 4)
    assert run(insult) == 1 and run(target, insult) == run(insult, other, target) == 1.25 and run(negation, insult) == 0.5 and run(said, insult) == 0.7
    assert run(negation, other, other, other, insult) == 1 and run(target, end, insult) == run(insult, end, target) == 1
    assert run(said, target, negation, insult) == round(1.25 * 0.5 * 0.7, 4) and run(target, insult, target) == 1.25
    assert run(head, link, link, insult) == 1.3 and run(head, insult) == run(link, insult) == run(head, link, end, insult) == 1
    assert run(intent, other, threat) == 2 and run(threat) == run(intent, other, other, other, other, threat) == 1 and run(intent, negation, threat) == 1
    assert m.run([insult, insult, end, insult], [1, 1, 0, 1]) == (2, 3, 3)


def test_composed_machine_is_the_layers_one_after_another():
    rng = np.random.default_rng(3)
    layers = list(toxicity.LAYERS.values())
    m = toxicity.Machine()
    for _ in range(300):
        read = rng.integers(0, toxicity.HIT, rng.integers(0, 40)).tolist()
        weights = rng.random(len(read)).tolist()
        now, gain, factor = list(read), [1.0] * len(read), [1.0] * len(read)
        for layer in layers:  # each reads the whole text that the one before has written
            state, written = 0, []
            for k, c in enumerate(now):
                gain[k] *= layer.gain[state, c]
                factor[k] *= layer.clause[state, c]
                written.append(int(layer.out[state, c]))
                state = int(layer.next[state, c])
            now = written
        clauses, clause, whole = [], 0.0, 1.0
        for k, c in enumerate([*now, toxicity.END]):
            if k < len(now):
                whole *= factor[k]
                clause += gain[k] * weights[k] if c == toxicity.HIT else 0.0
            if c == toxicity.END:
                clauses.append(clause * whole)
                clause, whole = 0.0, 1.0
        best, total, hits = m.run(read, weights)
        assert abs(best - max(clauses)) < 1e-9 and abs(total - sum(clauses)) < 1e-9 and hits == now.count(toxicity.HIT)


def test_clause_ends():
    import pyarrow as pa

    g = toxicity.Grammar({"idiot": 1.0}, {}, np.zeros(4))
    texts = ["you tue. idiot", "you tué. idiot", "you 2020. idiot", "you\nidiot", "you tué\nidiot", "you 12\n13 idiot", 'you "so." idiot', "you 3.5 idiot", "you, idiot", "idiot, you", "idiot.\nyou"]
    x = toxicity._features(pa.record_batch([pa.array(texts)], ["text"]), g, toxicity.Machine())
    assert x[:, 0].tolist() == [1.0] * 7 + [1.25] * 3 + [1.0]


def brute_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    n, r = len(words), len(hit)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_quality(odd, none, table):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for docs in (odd, table):
        rows = quality.quality_rules(docs).collect()
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        assert Counter((r.doc_id, *(r[c] for c in columns)) for r in rows) == Counter((d, *brute_quality(t)) for d, t in texts)
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality.quality_rules(none).collect() == []


def brute_repeats(words, shortest):
    """(words under repeated windows of 8, words under repeats, longest repeat, maximal repeats), by every substring."""
    n, spans, longest, maximal = len(words), {8: set(), shortest: set()}, 0, 0
    for size in range(shortest, n):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        for at in places.values():
            if len(at) > 1:
                longest = size
                for least, held in spans.items():
                    if size >= least:
                        held.update(j for i in at for j in range(i, i + size))
                before, after = {words[i - 1] if i else None for i in at}, {words[i + size] if i + size < n else None for i in at}
                maximal += (len(before) > 1 or None in before) and len(after) > 1
    return len(spans[8]), len(spans[shortest]), longest, maximal


def test_repeats():
    rng = np.random.default_rng(7)
    for _ in range(60):
        docs = []
        for _ in range(int(rng.integers(0, 5))):
            words = rng.integers(0, rng.choice([1, 2, 3, 20]), rng.integers(0, 40)).tolist()
            docs.append(words + words[: int(rng.integers(0, len(words) + 1))])
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        flat = np.array([w for d in docs for w in d], np.int64)
        for shortest in (2, 3, 5, 8):
            got = np.stack(quality.repeat_measures(flat, bounds, shortest), axis=1)
            assert [tuple(r) for r in got.tolist()] == [brute_repeats(d, shortest) for d in docs]


def test_repeats_of_one_word_are_linear():
    import tracemalloc

    n = 300_000
    tracemalloc.start()
    got = quality.repeat_measures(np.zeros(n, np.int64), np.array([0, n]))
    assert tracemalloc.get_traced_memory()[1] < 400 * n
    tracemalloc.stop()
    assert [x.tolist() for x in got] == [[n], [n], [n - 1], [n - 5]]


def test_verdict(spark):
    """kept against the brute measures; either limit rejects a text that the base keeps."""
    rng = np.random.default_rng(9)
    own = lambda n: [f"w{rng.integers(1 << 40)}" for _ in range(n)]
    short = own(6)
    many = [w for _ in range(8) for w in short + own(4)]
    stutter = own(74) + ["la"] * 22
    rows = [(0, " ".join(many), "en", "s"), (1, " ".join(stutter), "en", "s"), (2, " ".join(own(100)), "en", "s"), (3, "la " * 100, "en", "s")]
    for i in range(60):
        part = own(int(rng.integers(1, 12)))
        rows.append((4 + i, " ".join(w for _ in range(int(rng.integers(1, 6))) for w in part + own(int(rng.integers(0, 30)))), "en", "s"))
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _, _ in rows:
        words = text.split()
        windows, covered, longest, maximal = brute_repeats(words, quality.SHORTEST)
        base = len(words) < 20 or 100 * windows > 30 * len(words)
        r = got[i]
        assert (r.n_covered_words, r.longest_repeat, r.n_repeats, r.base_failed) == (covered, longest, maximal, base)
        assert r.kept == (not base and covered <= 0.3 * len(words) and longest <= 0.2 * len(words))
    assert [got[i].base_failed for i in range(4)] == [False, False, False, True]
    assert [got[i].kept for i in range(4)] == [False, False, True, False]
    assert got[0].longest_repeat <= 0.2 * got[0].n_words and got[1].n_covered_words <= 0.3 * got[1].n_words


def test_mix_odd_rows(odd, none):
    out = mixing.mix(odd, target_entropy=0.95)
    assert out.columns == [*(c for c in odd.columns if c != "mix_epoch"), "mix_epoch", "mix_block", "mix_block_order", "mix_doc_order"]
    first = Counter((r.doc_id, r.text, r.source) for r in out.where("mix_epoch = 0").collect())
    assert first == Counter((d, t, s) for d, t, _, s in ODD)
    assert mixing.mix(none).collect() == []


def test_mix_reaches_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{min(i % 40, 4)}") for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    tokens = {s: sum(1 + i % 7 for i in range(4000) if f"s{min(i % 40, 4)}" == s) for s in ("s0", "s1", "s2", "s3", "s4")}
    total = sum(tokens.values())

    def weights(**options):
        out = mixing.mix(docs, block_tokens=50, **options).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n"), F.max("mix_epoch").alias("e")).collect()
        return {r.source: r.n for r in out}, {r.source: r.e for r in out}

    got, epochs = weights(target_entropy=0.9, max_repetition=50.0, budget=total)
    share = np.array([got[s] for s in sorted(tokens)]) / sum(got.values())
    assert abs(-(share * np.log(share)).sum() - 0.9 * np.log(5)) < 0.02 and abs(sum(got.values()) - total) < 60
    got, epochs = weights(max_repetition=3.0)
    assert all(got[s] >= tokens[s] for s in tokens) and max(got[s] / tokens[s] for s in tokens) < 3.1 and max(epochs.values()) == 2
    got, _ = weights(target_entropy=0.0, max_repetition=1.0, budget=total // 2)
    assert abs(sum(got.values()) - total // 2) < 60


def test_insults_beside_other_marks():
    """Words are runs of letters when scored, as they are when learned."""
    import pyarrow as pa

    g = toxicity.Grammar({"idiota": 1.0}, {"dumm": 1.0}, np.zeros(4))
    texts = ["idiota", "¡idiota!", "“idiota”", "«idiota»", "so—idiota", "l'idiota", "l’idiota", "„dummkopf“", "¿dummkopf?"]
    x = toxicity._features(pa.record_batch([pa.array(texts)], ["text"]), g, toxicity.Machine())
    assert x[:, 0].tolist() == [1.0] * len(texts)
    sizes, kinds, _ = toxicity._classes(["3.5".encode(), b"...", b"don't", "ja…nein".encode()], g)
    E, N, O = toxicity.END, toxicity.NEGATION, toxicity.OTHER
    assert sizes.tolist() == [1, 1, 2, 3] and kinds.tolist() == [O, E, N, O, O, E, O]
