"""Vectorised word handling shared by the text operators.

Texts arrive as Arrow columns.  ``chunks`` joins them with line feeds into byte
buffers of about ``CHUNK`` bytes, so the arrays that numpy makes from a buffer stay
small whatever the size of an Arrow batch; a longer text is a buffer of its own.

Words are maximal runs of bytes other than space and ``\\x09-\\x0D``.  A word's hash
is a polynomial over random byte values modulo 2**64, taken from one running sum
over the buffer and passed through a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a uint64 array."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, CHUNK + 4096), base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > 2 * CHUNK:
            return both[0][:n], both[1][:n]
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def running_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums: entry i covers the first i bytes."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[buf] * up, out=out[1:])
    return out


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Slices [a, b) of texts with about size bytes each."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        if i > a and held + len(t) > size:
            yield a, i
            a, held = i, 0
        held += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


class Words:
    """The words of some texts: start, end and hash of each, and how many each text has."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b"\n".join(texts)
        self.raw = joined.lower() if lower else joined
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=self.at[1:])
        inside = np.zeros(len(self.buf) + 2, dtype=np.int8)
        np.logical_not(_SPACE[self.buf], out=inside[1:-1].view(bool))
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.at)  # of each text's words, and the total at the end
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        run = running_hash(self.buf)
        _, down = powers(len(self.buf))
        return mix((run[self.end] - run[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)


def shingles(words: Words, k: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text, and how many each text has.

    With short_whole a text of 1 to k-1 words gives its whole word sequence as one.
    """
    h, n = words.hashes(), words.count
    windows = np.maximum(n - k + 1, 0)
    short = (n > 0) & (n < k) & short_whole
    made = np.where(short, 1, windows)
    at = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(made, out=at[1:])
    first = np.repeat(words.first[:-1] - at[:-1], made) + np.arange(at[-1])
    last = len(h) - 1
    out = np.zeros(at[-1], dtype=np.uint64)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + h[np.minimum(first + j, last)] if len(out) else out
    for i in np.flatnonzero(short):
        v = 0x1F83D9ABFB41BD6B + int(n[i])
        for x in h[words.first[i] : words.first[i + 1]]:
            v = (v * 0xD6E8FEB86659FD93 + int(x)) % (1 << 64)
        out[at[i]] = v
    return mix(out), made


def distinct_by_owner(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, ordered by owner and value."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    o, v = owner[order], values[order]
    keep = np.ones(len(o), dtype=bool)
    if len(o):
        keep[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return o[keep], v[keep]
