"""Language identification with string kernels.

Kernel: the blended-spectrum presence kernel, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G are
the character n-grams of 1 to LONGEST that a text holds, hashed to BUCKETS. Landmarks (Nystroem) are
labelled texts; kernel ridge regression, one language against the rest, is solved in their span:

    alpha = (K_nm' K_nm + ridge n K_mm)^-1 K_nm' Y

The scores of a batch are one product of its presence matrix, over the buckets that some landmark has,
with (landmark presence x alpha), scaled by the texts' norms: by associativity the same as the kernel
matrix times alpha.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tomeweave.llm._sample import stratified
from tomeweave.llm._scored import with_columns
from tomeweave.llm._session import materialize
from tomeweave.llm._text import col, sliced

LONGEST, BUCKETS = 4, 1 << 18
#: Bounds of the fit: landmarks and labelled rows for each language, drawn by a hash of doc_id.
LANDMARKS, FIT_ROWS, RIDGE = 60, 800, 1e-4
#: Steepness of the softmax that turns scores into shares.
STEEP = 6.0
#: Texts whose presence stands in memory at once.
ROWS_AT_ONCE = 128
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


class Presence:
    """n-gram presence of one text at a time."""

    def __init__(self):
        self.map = np.zeros(BUCKETS, bool)

    def fill(self, text: str) -> int:
        """Mark the text's n-grams in ``map``; returns how many buckets they are."""
        self.map[:] = False
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(c), np.uint64)
        for n in range(min(LONGEST, len(c))):
            h = (h[: len(c) - n] ^ c[n:]) * _MULTIPLIERS[n]
            h ^= h >> np.uint64(29)
            self.map[(h >> np.uint64(11)) & np.uint64(BUCKETS - 1)] = True
        return int(np.count_nonzero(self.map))


class Model(NamedTuple):
    languages: list[str]
    buckets: np.ndarray  # that some landmark has
    weights: np.ndarray  # buckets x languages


def fit(labelled: DataFrame, landmarks: int = LANDMARKS, fit_rows: int = FIT_ROWS, ridge: float = RIDGE) -> Model:
    """Fit on rows (doc_id, text, lang); rows with null lang, or null or empty text, are left out.

    Takes about ``fit_rows`` rows of each language and of those about ``landmarks`` as landmarks; they are drawn by doc_id
    and lang alone and written once, so texts are read once. The driver gets the landmarks' n-gram buckets and the
    kernel rows, both of bounded size; long texts count whole. Repeated rows are drawn together. Without rows: a model
    without languages.
    """
    rows = labelled.where("lang is not null").select("doc_id", "text", "lang")
    drawn = materialize(stratified(rows, "lang", fit_rows).where("text is not null and text <> ''"))
    chosen = stratified(drawn, "lang", landmarks, salt="landmark")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for batch in batches:
            found = []
            for text in col(batch, "text").to_pylist():
                presence.fill(text)
                found.append(np.flatnonzero(presence.map).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["grams"])

    marks = [np.asarray(r[0]) for r in chosen.mapInArrow(grams, "grams array<int>").collect()]
    if not marks:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    buckets = np.unique(np.concatenate(marks))
    held = np.zeros((len(buckets), len(marks)), np.float32)
    for k, m in enumerate(marks):
        held[np.searchsorted(buckets, m), k] = 1 / np.sqrt(len(m))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in sliced(batches, "text", 1 << 20) for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            rows = np.zeros((batch.num_rows, len(buckets)), np.float32)
            for i, text in enumerate(col(batch, "text").to_pylist()):
                n = presence.fill(text)
                rows[i] = presence.map[buckets] / np.sqrt(n)
            yield pa.RecordBatch.from_arrays([col(batch, "lang"), pa.array(list((rows @ held).astype(np.float64)), pa.list_(pa.float64()))], ["lang", "k"])

    seen = drawn.mapInArrow(kernel, "lang string, k array<double>").collect()
    languages = sorted({r[0] for r in seen})
    k_nm = np.array([r[1] for r in seen])
    y = np.array([[1.0 if r[0] == x else -1.0 for x in languages] for r in seen])
    k_mm = held.T.astype(np.float64) @ held
    alpha = np.linalg.solve(k_nm.T @ k_nm + ridge * len(seen) * k_mm + 1e-9 * len(seen) * np.eye(len(marks)), k_nm.T @ y)
    return Model(languages, buckets, (held @ alpha).astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score (0 to 1), from the whole text alone.

    A text that is null or has no letter (``str.isalpha``; number signs are none), and any text if the model has no
    language, gets ``und`` with score 0. Repeated rows get equal results, an empty table gives no rows, and a text of any
    length is read whole. Columns named lang_pred and score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the size of the landmarks, which is bounded

    def make():
        m, presence = shared.value, Presence()

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            n = batch.num_rows
            matrix, norm, valid = np.zeros((min(n, ROWS_AT_ONCE), len(m.buckets)), np.float32), np.ones(n), np.zeros(n, bool)
            scores = np.zeros((n, max(1, len(m.languages))))
            texts = col(batch, "text").to_pylist()
            for begin in range(0, n, ROWS_AT_ONCE):
                for i, text in enumerate(texts[begin : begin + ROWS_AT_ONCE], begin):
                    valid[i] = bool(m.languages and text and any(map(str.isalpha, text)))
                    if valid[i]:
                        norm[i] = np.sqrt(presence.fill(text))
                        matrix[i - begin] = presence.map[m.buckets]
                    else:
                        matrix[i - begin] = 0
                if m.languages:
                    end = min(n, begin + ROWS_AT_ONCE)
                    scores[begin:end] = (matrix[: end - begin] @ m.weights) / norm[begin:end, None]
            top = scores.argmax(axis=1)
            share = np.exp(STEEP * (scores - scores.max(axis=1, keepdims=True)))
            share = share[np.arange(n), top] / share.sum(axis=1)
            names = [m.languages[t] if v else "und" for t, v in zip(top.tolist(), valid.tolist(), strict=True)]
            return [pa.array(names, pa.string()), pa.array(np.where(valid, share, 0.0))]

        return run

    added = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return with_columns(docs, added, make, 1 << 20)
