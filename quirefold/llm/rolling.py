"""Hashes of byte ranges for whole batches of texts at once, and access to Arrow's text buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(97)
TABLE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
        _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Ranges:
    """Polynomial hashes modulo 2**64 of any byte range of a buffer, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(TABLE[data] * _powers(BASE, n), out=self.sums[1:])
        self.back = _powers(INVERSE, n + 1)

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """The hash at each start at which that many bytes follow."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and n + 1 offsets into them; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int):
    """(first, last) runs of texts of at most ``limit`` bytes, one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
