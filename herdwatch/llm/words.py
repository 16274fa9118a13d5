"""Words of whole texts in numpy: one pass over an Arrow column's bytes, no Python per word.

A separator is always an ASCII byte and bytes from 0x80 on always belong to a word, so UTF-8
can be cut byte by byte.  A word is known by a 64-bit hash of its bytes: two different words
share one with a chance of 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SPACE = 32
#: Bytes of text that are worked on at once; a longer single text is a part of its own.
PART_BYTES = 1 << 19


def _table(is_separator) -> np.ndarray:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return np.where([is_separator(b) for b in range(256)], np.uint8(SPACE), lower).astype(np.uint8)


#: Words are runs of digits, letters and everything outside ASCII; A-Z are lower-cased.
ALNUM = _table(lambda b: b < 0x80 and not chr(b).isalnum())
#: Words are runs of anything but white space; A-Z are lower-cased.
SPACED = _table(lambda b: b in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = keys(256, 1)
_BASE = int(keys(1, 2)[0]) | 1
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _BASE, np.uint64)]))


def parts(table: pa.RecordBatch, column: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part have at most ``limit`` bytes, or it is one row."""
    if not table.num_rows:
        return
    sizes = np.frombuffer(pa.compute.fill_null(pa.compute.binary_length(table[column]), 0).cast(pa.int64()).buffers()[1], np.int64)[: table.num_rows]
    total, start = np.cumsum(sizes), 0
    while start < table.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield table.slice(start, end - start)
        start = end


def give_back() -> None:
    """Return freed memory to the system: allocators keep it, and a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that holds nothing of earlier tasks when it begins, nor of this one when it ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry than rows); null is empty."""
    column = pa.concat_arrays([pa.compute.fill_null(column.cast(pa.large_string()), "")])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every word, and the number of the first word of each row."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.not_equal(data, SPACE, out=inside[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given spans (not empty, ascending, not overlapping)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    # In place as far as can be: this is what a task's memory goes to.
    at = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    at[: starts[0]] = 0
    at[starts[0] :] -= np.repeat(starts.astype(at.dtype), np.diff(np.append(starts, len(data))))
    longest = int((ends - starts).max())
    powers = _POWERS
    while len(powers) < longest:
        powers = np.concatenate([powers, powers * (powers[-1:] * np.array([_BASE], np.uint64))])
    # Bytes between words may lie further from a word's start than the powers go; they cancel out.
    np.minimum(at, len(powers) - 1, out=at)
    total = powers.take(at)
    del at
    total *= _BYTE.take(data)
    np.cumsum(total, out=total)
    before = total[starts - 1]
    before[starts == 0] = 0
    return mix(total[ends - 1] - before)


def words(column: pa.Array, kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, first word of each row (one more entry than rows), and byte spans."""
    data, offsets = text_bytes(column)
    data = kind[data]
    starts, ends, first = spans(data, offsets)
    return hashes(data, starts, ends), first, starts, ends


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
