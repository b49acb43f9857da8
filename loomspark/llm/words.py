"""Words and Rabin-Karp hashes of whole texts, a batch at a time.

A prefix sum H of (byte + 1) * P^i modulo 2^64 gives the hash of any span as
(H[end] - H[start]) * P^-start, so words, shingles and windows of any length cost a few
array operations.  A final mix spreads the bits.  Two different words or windows share a
64-bit hash with a chance of about n^2 / 2^65 over n distinct ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64, fixed values)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; by a sort, which is an order faster here than np.unique."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of values[start:end] for every span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power_table(_P, len(values))[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power_table(_P_INVERSE, len(values))[starts]
    return mixed(h ^ ((ends - starts).astype(np.uint64) * np.uint64(_P)))


class Words:
    """The words of a string array: `data` bytes, `starts` and `ends` of words in them, and
    `first`, by text the number of its first word (one more at the end).  Null: no words."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        wide = pa.types.is_large_string(texts.type)
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        self.raw, self.data = raw, _LOWER[raw] if lower else raw
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~_SPACE[raw]
        begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
        begins[edges] = inside[1:-1][edges]
        stops[edges - 1] = inside[1:-1][edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, off)
        self.offsets = off

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word numbers) of all windows of `width` words within a text, and by text the
    number of its first window (one more at the end)."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    where = np.concatenate([[0], np.cumsum(n)])
    starts = np.arange(where[-1]) + np.repeat(first[:-1] - where[:-1], n)
    return starts, where
