"""Numpy views of Arrow text columns: words, word hashes, slices of bounded size.

The helpers run inside ``mapInArrow`` tasks.  They see one slice of a batch at a
time (``SLICE_BYTES`` of text, or a single longer document), so the memory of a
task does not depend on the number of rows of its partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes handled at once inside a task; one longer document makes one slice.
SLICE_BYTES = 2 << 20
#: Bytes whose 64-bit intermediate arrays live at the same time.
_HASH_BYTES = 1 << 20

#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

#: The blank characters of every contract here: space and 0x09 to 0x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only, so that byte offsets never move.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class TextSlice:
    """Documents ``first`` to ``first + len(starts)`` of a batch, as one byte array."""

    __slots__ = ("first", "data", "starts", "ends")

    def __init__(self, first: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.first, self.data, self.starts, self.ends = first, data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Returns freed memory to the system; a worker lives on after its task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Cuts a text column between documents into slices of about ``limit`` bytes; memory is given back after them."""
    data, offsets = text_column(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        base = offsets[i]
        yield TextSlice(i, data[base : offsets[j]], offsets[i:j] - base, offsets[i + 1 : j + 1] - base)
        i = j
    del data, offsets
    give_back()


def words(piece: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document (index in the slice) of every run of non-blank bytes."""
    data = piece.data
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = piece.starts[piece.starts < len(data)]
    first[edges] = solid[edges]
    before = edges[edges > 0] - 1
    last[before] = solid[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    docs = np.searchsorted(piece.starts, starts, side="right") - 1
    return starts, ends, docs


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` (bytes or code points) for ascending spans that don't overlap.

    Eight bytes at a time are mixed with their place before they are added up, so no
    family of texts collides by its form.  Equal hashes are a strong hint, no proof:
    what must be exact compares bytes (``distinct_spans``).
    """
    raw = data.view(np.uint8)
    unit = data.dtype.itemsize
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + _HASH_BYTES // unit, side="right")), i + 1)
        base = int(starts[i]) * unit
        block = np.concatenate([raw[base : int(ends[j - 1]) * unit], np.zeros(8, np.uint8)])
        s, size = starts[i:j] * unit - base, (ends[i:j] - starts[i:j]) * unit
        n = -(-size // 8)
        word = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(s, n) + 8 * word
        left = np.repeat(size, n) - 8 * word
        value = np.lib.stride_tricks.sliding_window_view(block, 8)[at].view("<u8").ravel() if len(at) else np.zeros(0, np.uint64)
        value = value & _KEEP[np.minimum(left, 8)]
        mixed = mix64(value + mix64(word.astype(np.uint64) + np.uint64(1)))
        some = n > 0
        sums = np.zeros(j - i, dtype=np.uint64)
        if len(mixed):
            sums[some] = np.add.reduceat(mixed, (np.cumsum(n) - n)[some])
        out[i:j] = sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix64(out)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each distinct content, and the content that each span has; contents are compared byte by byte."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unit = data.dtype.itemsize
    sizes = (ends - starts) * unit
    solid = ragged_gather(data, starts, ends - starts)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid.view(np.uint8))])
    which = np.asarray(spans.dictionary_encode().indices, dtype=np.int64)
    first = np.empty(int(which.max()) + 1, dtype=np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return first, which


def prefix_hashes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each place a 64-bit hash of ``data[begin:place]``; ``begin`` ascends and tells where the place's span starts."""
    place = np.arange(len(data), dtype=np.uint64)
    begun = begin.astype(np.int64)
    code = mix64(mix64(place - begin.astype(np.uint64) + np.uint64(1)) + data.astype(np.uint64))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(code, out=sums[1:])
    return mix64(sums[place.astype(np.int64)] - sums[begun] + (place - begin.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))


def group_starts(docs: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of each document's run in an ascending array of document indexes."""
    return np.searchsorted(docs, np.arange(n + 1))


def ragged_gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenates ``values[start:start + length]`` of every pair, in order."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    first = np.cumsum(lengths) - lengths
    return values[np.arange(total) + np.repeat(starts - first, lengths)]
