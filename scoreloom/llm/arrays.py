"""Vectorised helpers on Arrow batches of texts: word spans and 64-bit hashes without a Python object per word.

A string's hash is a polynomial over its bytes modulo 2**64 with a random value per byte, read off prefix sums,
then mixed. Texts are handled in slices of a few megabytes, always whole texts, so memory does not follow the
batch; one text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 4_000_000
IS_WS = np.zeros(256, bool)
IS_WS[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixer (the finaliser of splitmix64, published constants)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudorandom 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1_000_003)) * U(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended as needed."""

    def __init__(self, seed: int):
        base = int(stream(seed, 1)[0]) | 5
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)

            def grown(b: int) -> np.ndarray:
                p = np.full(size, b, U)
                p[0] = 1
                return np.multiply.accumulate(p)

            self.up, self.down = grown(self.base), grown(self.inverse)
        return self.up, self.down


_POWERS: dict[int, Powers] = {}


def powers(seed: int) -> Powers:
    return _POWERS.setdefault(seed, Powers(seed))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def slices(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about ``size`` bytes, SLICE if not given."""
    size = size or SLICE
    data, offs = buffers(texts)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offset of each text's first word in them (one more at the end)."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = IS_WS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    start = np.empty(len(data), bool)
    if len(data):
        start[0] = True
        np.logical_or(gap[:-2], cut[1:-1], out=start[1:])
        start &= ~gap[:-1]
    end = ~gap[:-1]
    end &= gap[1:] | cut[1:]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs, "left")


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = powers(seed).upto(len(data) + 1)
    table = stream(seed + 7, 256)
    if lower:
        table = table[LOWER]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def windows(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every ``k`` consecutive values of ``h``; windows that cross a text's end are for the caller to skip."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    mult = stream(seed + 31, k) | U(1)
    out = h[:n] * mult[0]
    for i in range(1, k):
        out += h[i : i + n] * mult[i]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
