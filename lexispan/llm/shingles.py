"""Word and shingle hashes of many texts at once, on arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_VALUE[_SPACE] = 0
CHUNK = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of lower-cased data."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    before = np.r_[True, space[:-1]]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    spans = np.diff(np.r_[starts, len(raw)])
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    powers = np.full(int(spans.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return starts, mixed(np.add.reduceat(_VALUE[raw[starts[0] :]] * powers[place], starts - starts[0]))


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased; some megabytes of text at a time."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
            size, to = size + len(texts[to]) + 1, to + 1
        data = b"\n".join(texts[at:to]).translate(_LOWER)
        if len(data) > 2 * CHUNK:  # one long text: in pieces that end at white space
            yield np.concatenate([_hash_words(piece)[1] for piece in _pieces(data)])
        else:
            starts, hashed = _hash_words(data)
            ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
            yield from np.split(hashed, np.searchsorted(starts, ends[:-1]))
        at = to


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        to = min(len(data), at + CHUNK)
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        yield data[at:to]
        at = to


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is one shingle."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return mixed((words * _PLACE[:n]).sum(keepdims=True) + _PLACE[63 - n : 64 - n])
    total = words[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        total = total + words[j : n - k + 1 + j] * _PLACE[j]
    return np.unique(mixed(total))


def minwise(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of minwise values (32 bits) for each non-empty set."""
    rng = np.random.default_rng(7)
    scale = rng.integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1)
    shift = rng.integers(1, 2**63, size, dtype=np.uint64)
    out = np.empty((len(sets), size), np.uint32)
    at = 0
    while at < len(sets):
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(sets[to]) <= CHUNK // 8):
            total, to = total + len(sets[to]), to + 1
        flat = np.concatenate(sets[at:to])
        first = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        for j in range(size):
            x = flat * scale[j] + shift[j]
            out[at:to, j] = np.minimum.reduceat((x ^ (x >> np.uint64(29))) * _BASE >> np.uint64(32), first)
        at = to
    return out
