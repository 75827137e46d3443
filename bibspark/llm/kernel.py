"""Array kernels that run inside Spark tasks.

They turn an Arrow column of texts into word boundaries and 64-bit hashes with whole-array operations.  Every
function handles a bounded slice of a batch at a time (``slices``), so memory follows the slice and the longest
single text, not the batch.  The module is pickled by value; executors need numpy and pyarrow only.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
U64 = np.uint64


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    m = np.zeros(256, bool)
    for lo, hi in ranges:
        m[lo:hi + 1] = True
    return m


#: fixed values: the byte classes that separate words, for the two word definitions in use
BLANKS = _mask((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = _mask((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
STEP = [int(x) | 1 for x in _rng.integers(1, 2**63, 16, dtype=np.uint64)]
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """``r**0 .. r**(n-1)`` modulo 2**64, grown when a longer word arrives."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, STEP[15], U64)]))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Runs of rows ``(i, j)`` of about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


class Words:
    """Words of a run of rows: ``start``/``length`` in ``data``, ``counts`` and ``bounds`` per row."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, i: int, j: int, separators: np.ndarray):
        base = offsets[i]
        self.data = LOWER[raw[base:offsets[j]]]
        inside = ~separators[self.data]
        first = offsets[i:j] - base
        edge = np.empty(len(inside) + 1, bool)
        edge[0], edge[-1] = (inside[0], inside[-1]) if len(inside) else (False, False)
        if len(inside):
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        # a word never runs over the end of its row
        cut = first[1:]
        cut = np.unique(cut[(cut > 0) & (cut < len(inside))])  # empty rows repeat a place
        cut = cut[inside[cut] & inside[cut - 1]]
        turns = np.flatnonzero(edge)
        if len(cut):
            turns = np.sort(np.concatenate([turns, cut, cut]))
        self.start, end = turns[0::2], turns[1::2]
        self.length = end - self.start
        self.inside = inside
        ends = np.searchsorted(self.start, offsets[i + 1:j + 1] - base, "left")
        self.bounds = np.concatenate([np.zeros(1, np.int64), ends])
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        if not len(self.start):
            return np.zeros(0, U64)
        at = np.flatnonzero(self.inside)
        firsts = np.cumsum(self.length) - self.length
        place = np.arange(len(at)) - np.repeat(firsts, self.length)
        terms = BYTE_CODE[self.data[at]] * powers(int(self.length.max()) + 1)[place]
        return mix(np.add.reduceat(terms, firsts) + self.length.astype(U64) * U64(STEP[14]))

    def word(self, k: int) -> bytes:
        return self.data[self.start[k]:self.start[k] + self.length[k]].tobytes()


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries; entry ``i`` starts at ``h[i]``."""
    if len(h) < k:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    out = np.full(n, U64(k))
    for t in range(k):
        out += h[t:t + n] * U64(STEP[t])
    return mix(out)


def short(h: np.ndarray) -> np.ndarray:
    """Hash of a whole sequence shorter than a window."""
    steps = np.array([STEP[t % 12] for t in range(len(h))], U64)
    return mix(np.array([len(h)], U64) * U64(STEP[13]) + (h * steps).sum(dtype=U64))


def shingle_sets(words: Words, k: int):
    """Sorted distinct shingle hashes of each row of ``words``."""
    h = words.hashes()
    w = windows(h, k)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= k:
            s = np.sort(w[a:b - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
        elif b > a:
            yield short(h[a:b])
        else:
            yield np.zeros(0, U64)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
