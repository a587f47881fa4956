"""Content-defined anchors: every window of `length` bytes belongs to its smallest-hashed gram, leftmost of equal ones.

Equal windows have their anchor at the same place, so windows that are equal anywhere meet under the same gram.
Windows of one anchor are consecutive; they make a cell, the stretch of text from the first window to the last one's end.
"""

from __future__ import annotations

from functools import cache

import numpy as np

GRAM = 48
_MULTIPLIER = 0xD1342543DE82EF95
_INVERSE = pow(_MULTIPLIER, -1, 2**64)
#: Bytes of text hashed at a time, and the most that can be.
CHUNK, LONGEST = 1 << 19, 1 << 21
_POSITION = np.uint64((1 << 20) - 1)
_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


@cache
def _powers(base: int) -> np.ndarray:
    """Made where texts are hashed: the driver, which imports this too, doesn't hold them."""
    out = np.full(LONGEST, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of all substrings of a chunk of text, in constant time each."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[raw] * _powers(_MULTIPLIER)[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _powers(_INVERSE)[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * _powers(_INVERSE)[:n])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, from running minima of blocks in both directions."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def cells(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, hash of the anchor's gram and hash of the cell, for every cell of the text."""
    out = []
    for at in range(0, len(data) - length + 1, CHUNK):
        part = Hashes(data[at : at + CHUNK + length - 1])
        grams = part.every(GRAM)
        keyed = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_minimum(keyed, length - GRAM + 1) & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, len(place) - 1]
        out.append((first + at, last + at, grams[place[first]], part.of(first, last + length) + (last - first).astype(np.uint64)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def first_anchor(data: bytes, length: int) -> int:
    """Place of the first window's anchor."""
    grams = Hashes(data[:length]).every(GRAM)
    return int(((grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)).argmin())
