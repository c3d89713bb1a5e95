"""Token counts with a unigram model, by dynamic programming over a shared trie.

A text's count is the sum over its pre-tokens (words with the word-begin mark). Distinct pre-tokens are put into one
trie; the forward score of a node, the best log probability of the string from the root, depends on that string alone,
so it is computed once for all pre-tokens that begin with it:

    score(node) = max over vocabulary pieces that end at node of score(node's ancestor before the piece) + log p(piece)

and the number of tokens of the best path is kept beside it; a pre-token's count is read off at its terminal node. A
code point that no piece covers is one token with a fixed low score.

Distinct pre-tokens are sorted, so a depth-first walk of the trie is one pass in which only the part after the common
prefix with the pre-token before is new: the path's scores stand on a stack.

The vocabulary is a public one and stays as it is; no public file gives its pieces probabilities, so those are
estimated: pre-tokens are counted over the whole corpus, and Viterbi re-estimation (EM with best paths) alternates the
walk above with counts of the pieces on the best paths. All counts are whole numbers, so the result doesn't depend on
the order of rows or on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._session import materialize, texts
from tomeweave.llm._text import col, raw_bytes, sliced, split_words

MARK = "▁"
#: Added to the lowest piece score for a code point outside the vocabulary.
UNKNOWN = -10.0
#: Rounds of re-estimation, and pre-tokens a task counts before it sends them on.
ROUNDS, COUNTED_AT_ONCE = 2, 1 << 17


def pieces_of(path: str | None = None) -> list[str]:
    """The pieces of a public sentencepiece vocabulary, without control, unknown, unused and byte pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class TrieCounter:
    """Best paths of pre-tokens under a unigram model."""

    def __init__(self, scores: dict[str, float]):
        self.unknown = min(scores.values(), default=0.0) + UNKNOWN
        #: Pieces by reversed text: what can end at a place is found by walking back while it is some piece's tail.
        self.tails: dict = {}
        for piece, score in scores.items():
            node = self.tails
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    def paths(self, ordered: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """Of distinct pre-tokens in ascending order: (itself, tokens up to each depth, where the token that ends there begins).

        Ties of score go to fewer tokens, then to the shorter last piece. The lists are valid until the next step.
        """
        best, number, begins = [0.0], [0], [0]  # by depth on the current path
        before, tails, unknown = "", self.tails, self.unknown
        for word in ordered:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], number[shared + 1 :], begins[shared + 1 :]
            for depth in range(shared, len(word)):
                score, n, begin = best[depth] + unknown, number[depth] + 1, depth
                node, at = tails, depth
                while at >= 0 and (node := node.get(word[at])) is not None:
                    if "" in node:
                        s, m = best[at] + node[""], number[at] + 1
                        if s > score or (s == score and m < n):
                            score, n, begin = s, m, at
                    at -= 1
                best.append(score)
                number.append(n)
                begins.append(begin)
            yield word, number, begins
            before = word

    def counts(self, ordered: list[str]) -> list[int]:
        """Tokens of distinct pre-tokens in ascending order."""
        return [number[-1] for _, number, _ in self.paths(ordered)]

    def pieces(self, ordered: list[str], times: list[int]) -> dict[str, int]:
        """How often each piece stands on the best paths of distinct pre-tokens in ascending order that occur so many times."""
        out: dict[str, int] = {}
        for (word, _, begins), n in zip(self.paths(ordered), times, strict=True):
            end = len(word)
            while end:
                piece = word[begins[end] : end]
                out[piece] = out.get(piece, 0) + n
                end = begins[end]
        return out


def pretoken_counts(docs: DataFrame) -> DataFrame:
    """word (with the word-begin mark) and n, its occurrences in all whole texts of ``docs``; counted in each task before any shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in sliced(batches, "text"):
            coded = split_words(*raw_bytes(col(batch, "text"))).array().dictionary_encode()
            for word, n in zip(coded.dictionary.to_pylist(), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist(), strict=True):
                held[word] = held.get(word, 0) + n
            if len(held) >= COUNTED_AT_ONCE:
                yield _rows(held)
                held = {}
        yield _rows(held)

    def _rows(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([MARK + w.decode("utf-8", "replace") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return texts(docs).select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit_scores(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> dict[str, float]:
    """Log probabilities of the vocabulary's pieces, re-estimated ``rounds`` times over the pre-tokens of all ``docs``.

    The first best paths are those of fewest tokens. A piece counts as seen once more than it is, so all keep a
    probability. The driver gets one number for each piece of the vocabulary. Without texts all pieces are alike.
    """
    pieces = pieces_of(path)
    scores = dict.fromkeys(pieces, -math.log(len(pieces)))
    words = materialize(pretoken_counts(docs).sortWithinPartitions("word"))
    shared = docs.sparkSession.sparkContext.broadcast  # of the size of the vocabulary
    for _ in range(rounds):
        now = shared(scores)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            counter = TrieCounter(now.value)
            for batch in batches:
                rows = sorted(zip(col(batch, "word").to_pylist(), col(batch, "n").to_pylist(), strict=True))
                if rows:
                    found = {p: n for p, n in counter.pieces(*map(list, zip(*rows, strict=True))).items() if p in now.value}
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

        seen = words.mapInArrow(expect, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = {r["piece"]: r["n"] for r in seen.collect()}
        total = sum(counts.values()) + len(pieces)
        scores = {p: math.log((counts.get(p, 0) + 1) / total) for p in pieces}
    return scores


def token_counts(docs: DataFrame, path: str | None = None, kept_words: int = 200_000, scores: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every whole text; null and empty texts have none.

    Pre-tokens are words ``[^\\x20\\x09-\\x0D]+`` with the word-begin mark before them. ``scores`` are those of the
    pieces; None: estimated over ``docs``, which is then read twice. Counts of up to ``kept_words`` pre-tokens are
    kept from batch to batch. Repeated rows stay repeated, extra columns are not read, an empty table gives no rows, and a
    long text is counted whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_scores(docs, path) if scores is None else scores)  # of the size of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(shared.value)
        known: dict[bytes, int] = {}
        for batch in sliced(batches, "text", 8 << 20):
            words = split_words(*raw_bytes(col(batch, "text")))
            coded = words.array().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(known) > kept_words:
                known.clear()
            new: dict[str, list[bytes]] = {}
            for w in distinct:
                if w not in known:
                    new.setdefault(MARK + w.decode("utf-8", "replace"), []).append(w)
            ordered = sorted(new)
            known.update((w, n) for text, n in zip(ordered, counter.counts(ordered), strict=True) for w in new[text])
            each = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
            total = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy()])))
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), pa.array(np.diff(words.docs)), pa.array(np.diff(total[words.docs]))], ["doc_id", "n_pretokens", "n_tokens"])

    rows = texts(docs)
    return rows.mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint")
