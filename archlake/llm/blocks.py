"""Texts of Arrow batches as flat byte arrays, and their words as 64-bit keys, without a Python loop over words.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Keys are 64-bit polynomial hashes with a final mix;
two different words of a corpus of 10**9 distinct words share a key with a chance of about 3 %.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a single longer text is a block of its own.
BLOCK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back to the system; idle workers would keep it beside later stages."""

    def then_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return then_free


def release() -> None:
    """This process gives memory that it has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_keys(lower: bool) -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b[65:91] += np.uint64(32)
    keys = mix(b + np.uint64(0x1234567)) | np.uint64(1)
    keys[SPACE] = 0
    return keys


KEYS, KEYS_LOWER = _byte_keys(False), _byte_keys(True)

_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for k, base in enumerate((_MULT, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows (from, to, bytes, offsets) of at most `limit` bytes, or one longer row."""
    data, offs = utf8(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for every row the index of its first word (with the total at the end)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    first = offs[:-1][offs[:-1] < offs[1:]]  # rows with bytes
    begin[first] = inside[first]
    last = offs[1:][offs[:-1] < offs[1:]] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_keys(data: np.ndarray, starts: np.ndarray, keys: np.ndarray = KEYS_LOWER) -> np.ndarray:
    """A 64-bit key of the bytes from each start to the next one; bytes whose key is 0 don't count."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(data))
    x = keys[data]
    x *= up
    return mix(np.add.reduceat(x, starts) * down[starts])


def word_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_spans and the words' keys, with A-Z lower-cased."""
    starts, ends, first = word_spans(data, offs)
    return starts, ends, first, span_keys(data, starts)


def shingle_keys(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of n words of each row, and each row's first run; a shorter row's words are one run."""
    counts = np.diff(first)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=out[1:])
    if not out[-1]:
        return np.empty(0, np.uint64), out
    at = np.repeat(first[:-1] - out[:-1], runs) + np.arange(out[-1])
    length = np.minimum(np.repeat(counts, runs), n)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        on = length > k
        h[on] = mix(h[on] + words[at[on] + k] + np.uint64(k + 1))
    return h, out


def strings_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
