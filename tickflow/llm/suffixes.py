"""Sampled suffixes of byte texts, and hashes of their prefixes (numpy, run inside tasks).

A window is ``width`` bytes of one text.  Its anchor is the position in it
whose ``GRAM`` bytes have the smallest hash (the leftmost of equal ones).
Equal windows have their anchors at the same place, so it is enough to sort
the suffixes at anchors, about one position in sixty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tickflow.llm.text import U64, mixed

#: Bytes compared first (the first digit of the radix passes).
GRAM = 64
#: Bytes worked on at once; longer texts are cut into overlapping segments.
BLOCK = 2 << 20
_M = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict = {}


def _powers(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the k-th multiplier and of its inverse, kept between the blocks of a task."""
    have = _POWERS.get(k)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 4096)
        m, inverse = _M[k], pow(_M[k], -1, 1 << 64)
        have = _POWERS[k] = tuple(np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, x, U64)])) for x in (m, inverse))
    return have


def forget_powers() -> None:
    """Drop them (some 60 MB); the next task that needs them makes them anew."""
    _POWERS.clear()


class Hashes:
    """Hashes of any substring of a block of bytes, from running sums."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.sums = raw, {}

    def of(self, begin: np.ndarray | slice, end: np.ndarray | slice, k: int = 0) -> np.ndarray:
        """64-bit hash of raw[begin:end] for each begin and end (arrays or slices)."""
        power, inverse = _powers(len(self.raw) + 1, k)
        if k not in self.sums:
            total = np.zeros(len(self.raw) + 1, U64)
            np.cumsum((self.raw.astype(U64) + U64(1)) * power[:len(self.raw)], out=total[1:])
            self.sums[k] = total
        return mixed((self.sums[k][end] - self.sums[k][begin]) * inverse[:len(self.raw) + 1][begin])


@dataclass
class Anchors:
    """Anchors of a block: position, and first and last start of the windows each belongs to (block positions)."""
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (van Herk: two running minima over blocks)."""
    n = len(x) - width + 1
    size = -(-len(x) // width) * width
    padded = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def anchors(hashes: Hashes, bounds: np.ndarray, width: int, gram: int = GRAM) -> Anchors:
    """Anchors of all windows within the segments bounds[i]:bounds[i + 1] of a block (below 2**24 bytes)."""
    n = len(hashes.raw)
    empty = np.empty(0, np.int64)
    if n < width:
        return Anchors(empty, empty, empty)
    order = hashes.of(slice(0, n - gram + 1), slice(gram, n + 1))
    order &= U64(0xFFFFFFFFFF000000)
    order |= np.arange(len(order), dtype=U64)
    own = (sliding_min(order, width - gram + 1) & U64(0xFFFFFF)).astype(np.int64)
    del order
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(own)]
    valid = np.arange(len(own)) + width <= bounds[segment + 1]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return Anchors(empty, empty, empty)
    own, segment = own[starts], segment[starts]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (segment[1:] != segment[:-1])]))
    return Anchors(own[new], starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])])
