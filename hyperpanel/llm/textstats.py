"""Vectorised word and window hashes over the UTF-8 bytes of many texts.

Hashes are sums of random byte values times powers of an odd number modulo
2^64; the sum of a span comes from two prefix sums, and the power of its start
is divided out, so equal spans have equal hashes wherever they stand.
"""

from __future__ import annotations

import functools

import numpy as np

from .common import WORD_SEPARATORS

_SEP = np.zeros(256, bool)
_SEP[list(WORD_SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=16)
def _base(lane: int) -> np.ndarray:
    """Random value of every byte; hashes of different lanes are independent."""
    return np.random.Generator(np.random.PCG64(1_000 + lane)).integers(1, 2**63, 256, dtype=np.uint64)


#: Odd, so that its powers can be divided out.
BASE = 0x5851F42D4C957F2D
_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        row = np.full(size, pow(BASE, -1, 1 << 64) if inverse else BASE, np.uint64)
        row[0] = 1
        have = np.multiply.accumulate(row)
        if size <= 1 << 21:  # those of an exceptionally long text are not kept
            _POWERS[inverse] = have
    return have[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(len(values), False), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(len(values) + 1, True)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(lane))


class Words:
    """Words of texts: ``start`` and ``end`` in the bytes, ``doc`` of each, ``first`` word of each text (and the end)."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        n = len(data)
        sep = _SEP[data]
        begins, stops = np.ones(n, bool), np.ones(n, bool)
        begins[1:], stops[:-1] = sep[:-1], sep[1:]
        edges = offsets[1:-1]
        begins[edges[edges < n]] = True
        stops[edges[edges > 0] - 1] = True
        self.start = np.flatnonzero(begins & ~sep)
        self.end = np.flatnonzero(stops & ~sep) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.data = data

    def hashes(self, lane: int = 0) -> np.ndarray:
        return spans_hash(_base(lane)[self.data], self.start, self.end, lane)

    def windows(self, hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
        """Hash of the ``k`` words from each word on; those that run over the end of a text are to be left out by :meth:`fits`."""
        at = np.arange(max(0, len(hashes) - k + 1))
        return spans_hash(hashes, at, at + k, lane)

    def fits(self, k: int) -> np.ndarray:
        """Is there a window of ``k`` words of one text at each word (as far as windows() goes)."""
        n = max(0, len(self.doc) - k + 1)
        return self.doc[:n] == self.doc[k - 1 : k - 1 + n]
