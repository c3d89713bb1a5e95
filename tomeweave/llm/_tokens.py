"""Token ids of whole texts with a public vocabulary file.

The vocabularies used here drop white space and never merge across it, nor across a change from a
letter to punctuation, so a text's ids are the ids of such pieces put together. Each distinct piece
of a batch is encoded once by the tokenizers library, many pieces to a call.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from tomeweave.llm._text import give_back, split_words

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Pieces given to the tokenizer as one text, and texts given to it at once: what it returns is many times as large.
JOINED, AT_ONCE = 500, 16

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


class WordEncoder:
    """Encodes batches of texts with a word-end BPE; keeps the ids of up to ``max_words`` pieces between batches."""

    def __init__(self, path: str | None = None, max_words: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        del vocabulary
        give_back()  # reading the file takes several times what the vocabulary does
        self.max_words = max_words
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.begins = np.zeros(1, np.int64)

    def _retain(self, words: list[bytes]) -> None:
        """Forget all but ``words``: what the batch at hand has again is likely to come again."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        begins, sizes = self.begins[at], self.begins[at + 1] - self.begins[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        self.flat = self.flat[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])]
        self.begins, self.known = ends, dict(zip(words, range(len(words)), strict=True))

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, sizes) of words that are one run of letters each: a word's last id is the one that ends a word."""
        joined = [b" ".join(words[i : i + JOINED]).decode("utf-8", "replace") for i in range(0, len(words), JOINED)]
        found = [np.array(x, np.uint32) for x in self._ids(joined, AT_ONCE)]
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            return None
        return ids, np.diff(last, prepend=-1)

    def _ids(self, texts: list[str], at_once: int) -> Iterator[list[int]]:
        for at in range(0, len(texts), at_once):
            for x in self.tokenizer.encode_batch_fast(texts[at : at + at_once], add_special_tokens=False):
                yield x.ids

    def _learn(self, missing: list[bytes]) -> None:
        plain = [w for w in missing if w.isalpha()]  # of bytes: ASCII letters only
        other = {w: w.decode("utf-8", "replace") for w in missing if not w.isalpha()}
        plain += [w for w, x in other.items() if x.isalpha() and max(x) < "İ"]
        coded = self._plain(plain)
        if coded is None:
            plain, coded = [], (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        done = set(plain)
        rest = [w for w in missing if w not in done]
        ids = [np.array(x, np.uint32) for x in self._ids([other.get(w) or w.decode("utf-8", "replace") for w in rest], AT_ONCE * 64)]
        self.known.update(zip(plain + rest, range(len(self.known), len(self.known) + len(missing)), strict=True))
        sizes = np.concatenate((coded[1], np.fromiter(map(len, ids), np.int64, len(ids))))
        more = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        self.flat = np.concatenate((self.flat, coded[0], more))
        self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(sizes)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets into ids for each text)."""
        breaks = None
        if b"<|" not in data.tobytes():  # special tokens are matched before case and marks are looked at
            letter, mark = _LETTER[data], _MARK[data]
            breaks = np.zeros(len(data), dtype=bool)
            breaks[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
            data = _LOWER[data]
        words = split_words(data, offsets, breaks)
        coded = words.array().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.max_words:
            self._retain([w for w in distinct if w in self.known])
        if missing := [w for w in distinct if w not in self.known]:
            self._learn(missing)
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        begins = self.begins[at]
        lengths = self.begins[at + 1] - begins
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.repeat(begins - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[words.docs]
