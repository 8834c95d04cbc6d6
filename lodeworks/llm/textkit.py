"""Vectorised word tools over Arrow text columns: word bounds, 64-bit word hashes, n-gram hashes.

A word is a maximal run of bytes outside \\x20 and \\x09-\\x0D. All functions work on whole texts; batches are cut into
slices of bounded bytes so that a worker's memory doesn't depend on how long the texts of a batch are.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, one after another
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # per text: index of its first word; one more entry at the end


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, giving freed memory back to the system when its task ends: Python workers outlive tasks."""

    @functools.wraps(work)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch holding about `limit` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = np.frombuffer(_offsets(batch.column(column)), np.int64)
    ends, start = sizes - sizes[0], 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return raw.astype(np.int64)


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Word bounds of every text of an Arrow string column; null and empty texts have no words."""
    if len(column) == 0 or column.buffers()[2] is None:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(len(column) + 1, np.int64))
    offsets = _offsets(column)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(column) + 1, np.int64))
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offsets] = True
    start = np.flatnonzero(edge[:-1] & ~space)
    edge[1:-1] = space[1:]
    edge[offsets] = True
    end = np.flatnonzero(edge[1:] & ~space) + 1
    if lower:
        data = LOWER[data]
    return Words(data, start, end, np.searchsorted(start, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), in place on a fresh array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: Words) -> np.ndarray:
    """64-bit hash of each word's bytes, eight bytes at a time."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(words.data) + 1,), "<u8", padded, 0, (1,))
    length = words.end - words.start
    out = mix((eight[words.start] & _MASK[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at, left, rest = words.start + 8, length - 8, np.flatnonzero(length > 8)
    while len(rest):
        out[rest] = mix(out[rest] * np.uint64(0xD6E8FEB86659FD93) ^ (eight[at[rest]] & _MASK[np.minimum(left[rest], 8)]))
        at, left = at + 8, left - 8
        rest = rest[left[rest] > 0]
    return out


def hash_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (an array shorter by n - 1); runs may cross texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, have, base = hashes.copy(), 1, np.uint64(0x9FB21C651E98DF25)
    parts: np.ndarray | None = None
    done, bits = 0, n
    while bits:
        if bits & 1:
            parts = out[: len(out)] if parts is None else _join(parts, done, out, base)
            done += have
        bits >>= 1
        if bits:
            out = _join(out, have, out, base)
            have *= 2
    return mix(parts.copy())


def _join(left: np.ndarray, n_left: int, right: np.ndarray, base: np.uint64) -> np.ndarray:
    """left covers n_left words from i, right its own run from i + n_left."""
    size = len(right) - n_left
    return left[:size] * _power(base, n_left) + mix(right[n_left:] + np.uint64(n_left))


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))
