"""Word boundaries and 64-bit word hashes of whole Arrow batches, in numpy.

Separators are ASCII, so words are found on UTF-8 bytes. A word's hash is a
polynomial over random 64-bit values of its bytes, finished by a mixer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_powers = np.ones(1, np.uint64)

#: Bytes of words: everything but space and \\x09-\\x0D.
BLANK = np.ones(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words of letters, digits and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every bit of x over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64), _R, np.uint64), dtype=np.uint64)])
    return _powers


@dataclass
class Words:
    """Words of a batch: byte spans in `data`, hashes, and for each document
    the range first[i]:first[i + 1] of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def find(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = BLANK, lower: bool = False) -> Words:
    n = len(data)
    if lower:
        data = LOWER[data]
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    m = is_word[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, m[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, m[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(data, starts, ends, np.zeros(0, np.uint64), first)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    value = _BYTE[data[m]] * _power(int(lens.max()))[place]
    return Words(data, starts, ends, mix(np.add.reduceat(value, at)), first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, over document borders."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _Q
        out += h[j : j + n]
    return mix(out)
