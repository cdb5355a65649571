"""Vectorised text kernels that run inside Spark tasks.

Everything here works on one bounded chunk of text at a time: Spark decides
which documents make up a chunk, these functions turn its bytes into words,
rolling hashes and sliding minima with whole-array numpy operations.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64

#: The six white-space bytes of the word rule [^\x20\x09-\x0D]+.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20250801)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Multipliers congruent 5 mod 8, for which powers repeat only after 2^62 steps.
BASES = (_RNG.integers(1, 2**60, 4, dtype=np.int64).astype(U64) << U64(3)) + U64(5)
INVERSES = np.array([pow(int(b), -1, 2**64) for b in BASES], dtype=U64)

_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers (from 0) of a base, or of its inverse, modulo 2^64."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), (INVERSES if inverse else BASES)[which], dtype=U64)
        steps[0] = 1
        have = _POWERS[which, inverse] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def prefix_hash(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of values[t] * base^t, with a leading 0."""
    out = np.empty(len(values) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(values * powers(which, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Rabin-Karp hashes of values[start:end], the same wherever the span lies."""
    return mix((prefix[ends] - prefix[starts]) * powers(which, len(prefix), True)[starts])


class Words:
    """The words of a chunk of documents.

    raw: the documents' bytes, each document followed by one separator.
    starts, ends: byte range of every word; doc: the document it is in.
    first: for each document the index of its first word, and one past the last.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if lower:
            self.raw = LOWER[self.raw]
        inside = np.empty(len(self.raw) + 1, dtype=np.int8)
        inside[0] = 0
        np.logical_not(IS_SPACE[self.raw], out=inside[1:].view(bool))
        edges = np.diff(inside)
        self.starts = np.flatnonzero(edges == 1)
        self.ends = np.flatnonzero(edges == -1)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.doc_ends = np.cumsum(lengths)
        self.doc_starts = self.doc_ends - lengths
        self.first = np.concatenate([[0], np.searchsorted(self.starts, self.doc_ends)])
        self.counts = np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word."""
        return span_hash(prefix_hash(BYTE_CODES[self.raw], 0), self.starts, self.ends, 0)


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the items at which a run of width items of one group begins."""
    n = int(counts.sum())
    ok = np.ones(n, dtype=bool)
    ends = np.cumsum(counts)
    begins = np.maximum(ends - counts, ends - (width - 1))
    short = ends - begins
    if n:
        ok[np.repeat(begins, short) + _ramp(short)] = False
    return np.flatnonzero(ok)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


ramp = _ramp


def gathered(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """raw[begin : begin + size] of all ranges, one after the other; indexes are made for about `most` bytes at a time."""
    out = np.empty(int(sizes.sum()), dtype=raw.dtype)
    ends = np.cumsum(sizes, dtype=np.int64)
    a = done = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        n = sizes[a:b].astype(np.int64)
        out[done : int(ends[b - 1])] = raw[np.repeat(begins[a:b], n) + _ramp(n)]
        a, done = b, int(ends[b - 1])
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values, in two passes whatever the width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, end)."""
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(depth[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of every maximal run of True."""
    edges = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
