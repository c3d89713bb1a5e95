"""Quality rules from a suffix array over words.

A text's words are numbered and its suffixes sorted by prefix doubling: rank pairs of 1, 2, 4, ... words, in which only
suffixes that still share a rank are sorted again. Common prefixes of neighbours are compared word by word only where
the words before differ; elsewhere they are one less than those of the place before (PLCP). Intervals of longest common
prefixes are the repeated substrings; those whose occurrences follow different words are maximal. The spans of
maximal repeats of at least SHORTEST words are united; limits hold on the covered share of words and on the longest repeat.

All arrays are as long as the words of a batch, so memory is linear, also for one word repeated throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._session import texts
from tomeweave.llm._text import col, raw_bytes, sliced, split_words

WINDOW, LEAST_WORDS, MOST_REPEATED, SHORTEST = 8, 20, 30, 5
#: Limits of the verdict: covered share of words, and longest repeat as a share of all words.
MOST_COVERED, LONGEST = 0.3, 0.2
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


class Repeats(NamedTuple):
    """Suffixes of several texts that share SHORTEST words with another of their text, sorted; neighbours' common prefixes."""

    places: np.ndarray
    common: np.ndarray  # with the suffix before; 0 if that one shares less than ``shortest`` words

    def intervals(self) -> np.ndarray:
        """(words, first, last) of every interval of longest common prefixes, by indices into ``places``."""
        found: list[tuple[int, int, int]] = []
        open_: list[tuple[int, int]] = []  # (words, first), words ascending
        for k, words in enumerate([*self.common.tolist(), 0]):
            first = k - 1
            while open_ and open_[-1][0] > words:
                deep, first = open_.pop()
                found.append((deep, first, k - 1))
            if words and (not open_ or open_[-1][0] < words):
                open_.append((words, first))
        return np.array(found, np.int64).reshape(-1, 3)

    def longest(self) -> np.ndarray:
        """Of each suffix the words of the innermost interval that holds it."""
        return np.maximum(self.common, np.append(self.common[1:], 0)) if len(self.common) else self.common


def _shared_words(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, known: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, of which ``known`` words are known to be equal."""
    out = np.full(len(a), known, np.int64)
    open_, width = np.arange(len(a)), 4
    while len(open_):
        still = []
        for at in range(0, len(open_), 1 << 14):
            part = open_[at : at + (1 << 14)]
            t = out[part, None] + np.arange(width)
            inside = t < most[part, None]
            t = np.where(inside, t, 0)
            equal = inside & (words[a[part, None] + t] == words[b[part, None] + t])
            run = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
            out[part] += run
            still.append(part[run == width])
        open_, width = np.concatenate(still), min(256, 4 * width)
    return out


def find_repeats(words: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST) -> Repeats:
    """Repeats of at least ``shortest`` (2 or more) words inside each text; text d is words[bounds[d]:bounds[d + 1]]."""
    n, none = len(words), Repeats(np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not n:
        return none
    sizes = np.diff(bounds)
    begin, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    key = begin * (int(words.max()) + 1) + words
    live, h = np.argsort(key), 1
    key = key[live]
    rank, base, seen = np.empty(n, np.int64), np.zeros(n, np.int64), None
    while True:
        new = np.ones(len(live), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        # members of one rank stand together from ``base`` on; a suffix's rank is the place of the first of its equals
        runs = np.flatnonzero(np.append(True, base[1:] != base[:-1]))
        place = base + np.arange(len(live)) - np.repeat(runs, np.diff(np.append(runs, len(live))))
        base = place[heads][np.cumsum(new) - 1]
        rank[live] = base
        several = ~(new & np.append(new[1:], True))
        live, base = live[several], base[several]
        if seen is None and 2 * h > shortest:
            seen, group, known = live, base, h
        if not len(live):
            break
        after = live + h
        key = base * (n + 1) + np.where(after < end[live], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        live, base, key = live[order], base[order], key[order]
        h *= 2
    if seen is None or not len(seen):
        return none
    order = np.argsort(rank[seen])
    places, group = seen[order], group[order]
    second = np.flatnonzero(group[1:] == group[:-1]) + 1  # shares ``known`` words with the one before
    a, b = places[second], places[second - 1]
    told = (a > begin[a]) & (b > begin[b]) & (words[a - 1] == words[b - 1])  # one word less than the place before
    common = np.zeros(len(second), np.int64)
    common[~told] = _shared_words(words, a[~told], b[~told], end[a[~told]] - np.maximum(a, b)[~told], known)
    by_place = np.argsort(a)
    at, value, told = a[by_place], common[by_place], told[by_place]
    source = np.maximum.accumulate(np.where(told, 0, np.arange(len(at))))
    common[by_place] = value[source] - (at - at[source])
    out = np.zeros(len(places), np.int64)
    out[second] = np.where(common >= shortest, common, 0)
    keep = (out > 0) | (np.append(out[1:], 0) > 0)
    return Repeats(places[keep], out[keep])


def _covered(places: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text the words under the spans of ``lengths`` words from ``places`` on."""
    change = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + lengths, -1)
    return np.diff(np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))[bounds])


def repeat_measures(words: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words in repeated WINDOW-word windows, words covered by repeats, longest repeat, number of maximal repeats.

    A suffix counts with its innermost interval. That covers what the maximal repeats cover: where an interval isn't
    maximal, each of its occurrences follows the same word and lies in a longer repeat.
    """
    r = find_repeats(words, bounds, shortest)
    length = r.longest()
    doc = np.searchsorted(bounds, r.places, side="right") - 1
    most = np.zeros(len(bounds) - 1, np.int64)
    np.maximum.at(most, doc, length)
    number = np.zeros(len(bounds) - 1, np.int64)
    if len(length):
        parts = r.intervals()
        differs = np.ones(len(r.places), np.int64)  # is the word before it another than the neighbour's?
        a, b = r.places[1:], r.places[:-1]
        differs[1:] = (a == bounds[doc[1:]]) | (b == bounds[doc[:-1]]) | (words[a - 1] != words[b - 1])
        total = np.cumsum(differs)
        np.add.at(number, doc[parts[:, 1]], total[parts[:, 2]] > total[parts[:, 1]])
    wide = length >= WINDOW
    return _covered(r.places[wide], length[wide], bounds), _covered(r.places, length, bounds), most, number


def measure(docs: DataFrame) -> DataFrame:
    """Measures of every text, null counting as empty.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in WINDOW-word windows
    that occur twice or more), n_covered_words (words under repeats of SHORTEST words or more), longest_repeat
    (words; 0 if below SHORTEST), n_repeats (maximal repeats). Extra columns of ``docs`` are not read.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "n_repeats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, offsets = raw_bytes(col(batch, "text"))
            words = split_words(data, offsets)
            code = words.array().dictionary_encode().indices.to_numpy()
            lead = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
            marks = np.concatenate(([0], np.cumsum(_SYMBOL[words.data])))
            at = words.offsets[words.docs]
            whole = data.tobytes()
            doubled = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                lines = [x for x in whole[a:b].split(b"\n") if x.strip(b" \t\n\v\f\r")]
                doubled.append(len(lines) - len(set(lines)))
            columns = [np.diff(words.docs), np.diff(lead[at]), np.diff(marks[at]), doubled, *repeat_measures(code.astype(np.int64), words.docs)]
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), *(pa.array(np.asarray(c, np.int64)) for c in columns)], names)

    rows = texts(docs)
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def quality_rules(docs: DataFrame, most_covered: float = MOST_COVERED, longest: float = LONGEST) -> DataFrame:
    """Measures with base_failed and kept.

    base_failed: fewer than LEAST_WORDS words, or over MOST_REPEATED % of words in repeated windows.
    kept: not base_failed, repeats of SHORTEST words or more cover at most ``most_covered`` of the words, and the longest
    has at most ``longest`` of them. Either limit can reject what the base keeps: many short repeats that no window
    catches, or one word said over and over in a fifth of a text. Empty and null texts fail; repeated rows stay
    repeated; an empty table gives no rows; a text of any length is judged whole.
    """
    m = measure(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    good = (F.col("n_covered_words") <= F.lit(most_covered) * F.col("n_words")) & (F.col("longest_repeat") <= F.lit(longest) * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)
