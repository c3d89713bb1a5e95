"""Toxicity by a weighted finite-state pattern grammar.

A text is a sequence of clauses, a clause a sequence of words, and a lexicon turns each word into a class (and insults and
threats into a weight). Five transducers then read a clause one after the other; each is data (states, rules) and rewrites
classes, scales the hits it reads or the whole clause:

  insult          insults are hits; more after a head and its links ("piece of ...")
  threat          words of violence are hits; more within INTENDED words after an intent ("will ...")
  target          a clause that names a person, before or after its hits, counts more
  negation        a hit up to NEGATED words after a negation counts less
  reported        a hit after a verb of saying counts less

``compose`` makes one transducer of two, so the five are one machine and a text is read once. A clause's score is the sum of
its scaled hits times its own factor. A document's score is a logistic function of its best clause, its sum and its hits for
each word, so words out of place don't add up to a verdict by themselves.

Insults are learned: words and word beginnings that labelled toxic rows have and others don't.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tomeweave.llm._sample import stratified
from tomeweave.llm._session import materialize
from tomeweave.llm._scored import with_columns
from tomeweave.llm._text import col, raw_bytes, sliced, split_words
from tomeweave.llm._tokens import _LETTER, _LOWER, _MARK

#: Bound of the fit: labelled rows of either label.
FIT_ROWS = 6000
#: A word or beginning is an insult if so large a share of the rows that have it are toxic (at equal label counts), and so
#: large a share of the toxic rows has it, but so many rows at least.
LEAST_SHARE, LEAST_ROWS = 0.985, {"word": (0.004, 3), "beginning": (0.015, 5)}
BEGINNINGS = (4, 5, 6, 7)
#: How far an intent and a negation reach, in words.
INTENDED, NEGATED = 4, 3
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED, END, INTENT, HEAD, LINK, HIT = range(11)
#: Words of the grammar in English, German, French and Spanish.
WORDS = {
    THREAT: "kill hurt destroy burn beat töten umbringen vernichten tuer détruire frapper matar destruir quemar",
    TARGET: "you your he she they them people du dich dir ihr euch leute tu toi vous vos ils tú ustedes ellos gente",
    NEGATION: "not no never without don isn aren wasn weren won didn doesn nicht kein keine nie ohne ne pas jamais sans nunca sin",
    REPORTED: "said says called wrote quoted claimed sagte sagt nannte schrieb dit écrit appelé dijo dice llamó escribió",
    INTENT: "will gonna shall ll werde wird vais va voy vamos",
    HEAD: "piece pile bunch sack son stück haufen sohn tas bande fils pedazo montón hijo",
    LINK: "of a an von einer de du une un una la",
}
#: Marks that end a clause (or begin the next), and closing marks that may follow them.
CLAUSE_ENDS, CLOSING = ".;:!?…¡¿", "\"')]»“”’"
#: Stands for a line's end, which ends a clause too.
_LINE_END = 0x1E
THREAT_WEIGHT, INTENT_GAIN, PHRASE_GAIN, TARGET_GAIN, NEGATION_LOSS, REPORTED_LOSS = 0.5, 2.0, 1.3, 1.25, 0.5, 0.7


class Transducer(NamedTuple):
    """A complete deterministic transducer over the classes, by state and class read; it starts in state 0."""

    next: np.ndarray
    out: np.ndarray  # the class written
    gain: np.ndarray  # factor on a hit that is read or made here
    clause: np.ndarray  # factor on the whole clause


def transducer(states: int, falls: dict[int, int], rules: dict[tuple[int, int], tuple]) -> Transducer:
    """``rules``: (state, class) to (next state, class written, gain, factor on the clause), later ones optional.

    Where no rule holds, the class is passed on and the state falls to ``falls`` of it (0 by default). A clause's end
    leads back to state 0.
    """
    every = np.tile(np.arange(HIT + 1), (states, 1))
    made = Transducer(np.array([[falls.get(q, 0)] * (HIT + 1) for q in range(states)]), every.copy(), np.ones(every.shape), np.ones(every.shape))
    made.next[:, END] = 0
    for (state, read), (to, *more) in rules.items():
        made.next[state, read] = to
        for table, value in zip(made[1:], more, strict=False):
            table[state, read] = value
    return made


def compose(first: Transducer, then: Transducer) -> Transducer:
    """The transducer that does what ``then`` does with what ``first`` writes; states are the pairs that can be reached."""
    place, queue = {(0, 0): 0}, [(0, 0)]
    rows: list[list[tuple]] = []
    for a, b in queue:  # grows meanwhile
        row = []
        for read in range(HIT + 1):
            passed = int(first.out[a, read])
            to = (int(first.next[a, read]), int(then.next[b, passed]))
            if to not in place:
                place[to] = len(queue)
                queue.append(to)
            row.append((place[to], int(then.out[b, passed]), first.gain[a, read] * then.gain[b, passed], first.clause[a, read] * then.clause[b, passed]))
        rows.append(row)
    return Transducer(*(np.array([[x[k] for x in row] for row in rows]) for k in range(4)))


#: The five layers in order of reading.
LAYERS = {
    "insult": transducer(3, {}, {(0, HEAD): (1,), (1, HEAD): (1,), (2, HEAD): (1,), (1, LINK): (2,), (2, LINK): (2,), (0, INSULT): (0, HIT), (1, INSULT): (0, HIT), (2, INSULT): (0, HIT, PHRASE_GAIN)}),
    "threat": transducer(
        INTENDED + 1,
        {q: q - 1 for q in range(1, INTENDED + 1)},
        {(q, INTENT): (INTENDED,) for q in range(INTENDED + 1)} | {(q, THREAT): (0, HIT, INTENT_GAIN if q else 1.0) for q in range(INTENDED + 1)},
    ),
    "target": transducer(2, {1: 1}, {(0, TARGET): (1, TARGET, 1.0, TARGET_GAIN)}),
    "negation": transducer(
        NEGATED + 1, {q: q - 1 for q in range(1, NEGATED + 1)}, {(q, HIT): (q - 1, HIT, NEGATION_LOSS) for q in range(1, NEGATED + 1)} | {(q, NEGATION): (NEGATED,) for q in range(NEGATED + 1)}
    ),
    "reported": transducer(2, {1: 1}, {(0, REPORTED): (1,), (1, HIT): (1, HIT, REPORTED_LOSS)}),
}


class Machine:
    """All layers as one transducer."""

    def __init__(self, layers: Iterable[Transducer] = LAYERS.values()):
        self.whole = functools.reduce(compose, layers)
        self.table = [list(zip(*rows, strict=True)) for rows in zip(*(t.tolist() for t in self.whole), strict=True)]

    def run(self, classes: list[int], weights: list[float]) -> tuple[float, float, int]:
        """(best clause, sum, hits) of a text."""
        state, clause, factor, best, total, hits = 0, 0.0, 1.0, 0.0, 0.0, 0
        for c, w in zip(classes, weights, strict=True):
            state, out, gain, whole = self.table[state][c]
            factor *= whole
            if out == HIT:
                clause += gain * w
                hits += 1
            elif c == END:
                best, total, clause, factor = max(best, clause * factor), total + clause * factor, 0.0, 1.0
        return max(best, clause * factor), total + clause * factor, hits


class Grammar(NamedTuple):
    words: dict[str, float]  # insults and their weights
    beginnings: dict[str, float]
    logistic: np.ndarray  # intercept and three coefficients


def _classes(distinct: list[bytes], g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of classes of each distinct word, the classes and their weights; a word has one for each run of letters, as in ``fit``."""
    fixed = {w: c for c, text in WORDS.items() for w in text.split()}
    sizes, classes, weights = np.ones(len(distinct), np.int64), [], []

    def add(c: int, w: float = 0.0):
        classes.append(c)
        weights.append(w)

    for i, raw in enumerate(distinct):
        word, before = raw.decode("utf-8", "replace").lower(), len(classes)
        runs = [(True, word)] if word.isalpha() else [(k, "".join(r)) for k, r in itertools.groupby(word, str.isalpha)]
        for k, (letters, w) in enumerate(runs):
            if not letters:
                # a mark between digits (3.5) ends nothing; one at the end, or between letters, does
                if (any(x in w for x in CLAUSE_ENDS) if k + 1 < len(runs) else w.rstrip(CLOSING)[-1:] in tuple(CLAUSE_ENDS)) or chr(_LINE_END) in w:
                    add(END)
            elif w in g.words:
                add(INSULT, g.words[w])
            elif w in fixed:
                add(fixed[w], THREAT_WEIGHT if fixed[w] == THREAT else 0.0)
            elif found := [g.beginnings[w[:n]] for n in BEGINNINGS if len(w) > n and w[:n] in g.beginnings]:
                add(INSULT, max(found))
            else:
                add(OTHER)
        if len(classes) == before:
            add(OTHER)
        sizes[i] = len(classes) - before
    return sizes, np.array(classes, np.int8), np.array(weights)


def _features(batch: pa.RecordBatch, grammar: Grammar, machine: Machine) -> np.ndarray:
    data, offsets = raw_bytes(col(batch, "text"))
    data = np.where(data == 0x0A, np.uint8(_LINE_END), data)
    letter, mark = _LETTER[data], _MARK[data] | (data == _LINE_END)
    breaks = np.zeros(len(data), bool)
    breaks[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    words = split_words(_LOWER[data], offsets, breaks)
    coded = words.array().dictionary_encode()
    at = coded.indices.to_numpy()
    sizes, kinds, weights = _classes(coded.dictionary.to_pylist(), grammar)
    ends = np.concatenate(([0], np.cumsum(sizes[at])))
    places = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], sizes[at])
    kind, weight, docs = kinds[places], weights[places], ends[words.docs]
    hits = np.concatenate(([0], np.cumsum((kind == INSULT) | (kind == THREAT))))
    out = np.zeros((batch.num_rows, 3))
    some = np.flatnonzero(np.diff(hits[docs]))
    for d in some.tolist():
        i, j = docs[d], docs[d + 1]
        best, total, n = machine.run(kind[i:j].tolist(), weight[i:j].tolist())
        out[d] = best, np.log1p(total), n / (j - i)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a ridge-penalised logistic regression, by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) * max(1, len(x)) / 100
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Grammar:
    """Fit on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0 or 1) marks.

    About ``fit_rows`` labels of either value are drawn by a hash of doc_id; so few that they are broadcast to
    find their texts, and no text is shuffled. Words are counted on the executors; the driver gets those that
    pass the thresholds, and three numbers a row. Null labels and texts are left out. Without rows of both
    labels the grammar has no learned words.
    """
    marked = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = materialize(stratified(marked, "toxic", fit_rows))
    drawn = materialize(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id"))
    sizes = {r[0]: r[1] for r in drawn.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        base = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
        return Grammar({}, {}, np.array([np.log(base[0] / base[1]), 0.0, 0.0, 0.0]))
    scale = sizes[1] / sizes[0]
    words = drawn.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("w"))
    counts = materialize(words.groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")))

    def sure(df: DataFrame, what: str) -> DataFrame:
        share, rows = LEAST_ROWS[what]
        return df.where((F.col("p") >= max(rows, share * sizes[1])) & (F.col("p") >= LEAST_SHARE * (F.col("p") + scale * F.col("n"))))

    weight = lambda r: float(min(3.0, np.log((r["p"] + 0.5) / (scale * r["n"] + 0.5)) / 2))
    insults = {r["w"]: weight(r) for r in sure(counts, "word").collect()}
    begun = counts.select("p", "n", F.explode(F.array(*(F.when(F.length("w") > k, F.substring("w", 1, k)) for k in BEGINNINGS))).alias("w"))
    stems = {r["w"]: weight(r) for r in sure(begun.where("w is not null").groupBy("w").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "beginning").collect()}
    grammar = Grammar(insults, stems, np.zeros(4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()
        for batch in sliced(batches, "text"):
            x = _features(batch, grammar, machine)
            yield pa.RecordBatch.from_arrays([col(batch, "toxic"), *(pa.array(c) for c in x.T)], ["toxic", "a", "b", "c"])

    seen = np.array([tuple(r) for r in drawn.select("toxic", "text").mapInArrow(run, "toxic int, a double, b double, c double").collect()])
    w = _logistic(seen[:, 1:], seen[:, 0])
    total = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    w[0] += np.log(total[1] / total[0]) - np.log(scale)  # from the drawn share of toxic rows to that of all
    return Grammar(insults, stems, w)


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on), from the whole text alone.

    Null and empty texts have no hits and get the score of such texts. Repeated rows get equal scores, an empty table gives
    no rows, a text of any length is read whole. Columns named score and predicted are replaced, all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # words of a bounded sample

    def make():
        machine = Machine()

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            x = np.column_stack((np.ones(batch.num_rows), _features(batch, shared.value, machine)))
            p = 1 / (1 + np.exp(-np.clip(x @ shared.value.logistic, -30, 30)))
            return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

        return run

    return with_columns(docs, StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())]), make)
