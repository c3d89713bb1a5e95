"""Columnar text helpers used inside Arrow functions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes that part words: space and 0x09 to 0x0D. All are ASCII, so UTF-8 bytes can be tested.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: Each byte with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(offsets) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words(NamedTuple):
    """Words of several texts: word k is data[offsets[k]:offsets[k+1]], text d has words docs[d] to docs[d+1]."""

    data: np.ndarray
    offsets: np.ndarray
    docs: np.ndarray

    def array(self) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data)]
        )


def split_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; ``breaks`` marks bytes that begin a word besides."""
    solid = ~SEPARATOR[data]
    starts = solid.copy()
    if len(solid):
        starts[1:] &= ~solid[:-1]
        first = offsets[:-1][offsets[:-1] < len(data)]
        starts[first] = solid[first]
        if breaks is not None:
            starts |= breaks
    at = np.flatnonzero(starts)
    before = np.cumsum(solid, dtype=np.int32)  # a batch's text is below 2**31 bytes
    word_offsets = np.empty(len(at) + 1, np.int64)
    word_offsets[:-1] = before[at] - 1 if len(at) else 0
    word_offsets[-1] = before[-1] if len(before) else 0
    return Words(np.ascontiguousarray(data[solid]), word_offsets, np.searchsorted(at, offsets))


def give_back() -> None:
    """Return freed memory to the system: a task's worker lives on and takes tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def sliced(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``max_bytes`` of text, a longer text alone; small batches are put together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offsets = raw_bytes(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + max_bytes, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            n = int(offsets[end] - offsets[begin])
            if held and size + n > max_bytes:
                yield _together(held)
                held, size = [], 0
            held.append(batch.slice(begin, end - begin))
            begin, size = end, size + n
    if held:
        yield _together(held)
    give_back()


def _together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
