"""Byte-level vector tokenization shared by the corpus operators.

The word patterns of this package separate words by ASCII bytes only, and UTF-8 never uses an
ASCII byte inside a longer character, so words can be cut on the raw bytes of an Arrow string
column without decoding it. Every function works on whole texts.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes handled at once; a longer single text is handled alone.
CHUNK_BYTES = 2 << 20

_SEED = np.random.default_rng(20240607)
_BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = int(_SEED.integers(1, 2**62)) * 8 + 5
_BASE_INV = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+ .
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ .
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(k: int, n: int) -> np.ndarray:
    """The first n powers (mod 2**64) of the base (k = 0) or of its inverse (k = 1)."""
    if len(_powers[k]) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), (_BASE, _BASE_INV)[k], np.uint64)
        out[0] = 1
        _powers[k] = np.multiply.accumulate(out)
    return _powers[k][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def tidy() -> None:
    """Give freed memory back to the system; workers wait for their next task with what they keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run: Callable) -> Callable:
    """A batch or group function that tidies up after itself."""

    @wraps(run)
    def batches(it):
        yield from run(it)
        tidy()

    @wraps(run)
    def group(t):
        out = run(t)
        tidy()
        return out

    return batches if inspect.isgeneratorfunction(run) else group


class Words(NamedTuple):
    data: np.ndarray  # lower-cased bytes of the chunk's texts
    start: np.ndarray  # byte at which each word starts
    end: np.ndarray
    hash: np.ndarray  # 64-bit hash of each word
    first: np.ndarray  # for each text, its first word; one more entry closes the last text

    @property
    def doc(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of pieces of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def cut(data: np.ndarray, off: np.ndarray, is_word: np.ndarray, hashed: bool = True) -> Words:
    """The words of one chunk; a word never crosses from one text into the next."""
    data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = off[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    if len(inner):
        crossed = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]
        if len(crossed):
            start, end = np.sort(np.concatenate([start, crossed])), np.sort(np.concatenate([end, crossed]))
    h = np.zeros(len(start) if hashed else 0, np.uint64)
    i = 0
    while i < len(h):  # by stretches of words, so that a very long text needs no more memory than a chunk
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK_BYTES, "right")))
        part, at, to = data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[part] * _power(0, len(part)), out=total[1:])
        h[i:j] = mix((total[to] - total[at]) * _power(1, len(part) + 1)[at] + (to - at).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        i = j
    return Words(data, start, end, h, np.searchsorted(start, off))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (runs over text ends included)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * U(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(h)
