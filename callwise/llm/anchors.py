"""Content anchors: every stretch of a text of a given length belongs to one of its grams, by content alone."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes of a gram.
GRAM = 24
#: Bits of a sort key that hold a place in the bytes hashed at once.
_PLACE = 24


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the hash base and of its inverse, kept for the longest bytes met."""

    def __init__(self) -> None:
        self.size, self.up, self.down = 0, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            up, down = np.full(n + 1, _P, np.uint64), np.full(n + 1, _P_INV, np.uint64)
            up[0] = down[0] = 1
            self.size, self.up, self.down = n, np.cumprod(up), np.cumprod(down)
        return self.up, self.down


class PrefixHash:
    """Hashes of any ranges of a byte string, from one pass; equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.upto(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def anchored_runs(data: np.ndarray, bounds: np.ndarray, length: int, powers: Powers, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of starts of ``length``-byte stretches with the same anchor, in texts laid end to end.

    ``bounds`` are the ends of the texts; no stretch crosses one. The anchor of a stretch is the rightmost of its grams with the
    least hash, so equal stretches have equal anchors at equal distance. The snippet of a run is all bytes
    of its stretches; its hash takes in where the anchor stands. Returns text number, anchor hash, snippet hash, anchor,
    first and last start.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    if len(data) >= 1 << _PLACE:
        raise ValueError("too many bytes at once")
    ranges = PrefixHash(data, powers)
    hashes = ranges.grams(gram)
    # The hash and, for the rightmost of equal ones, the place from the right; then the least of each window by doubling.
    mask = np.uint64((1 << _PLACE) - 1)
    best = (hashes & ~mask) | (mask - np.arange(len(hashes), dtype=np.uint64))
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    place = (mask - (best & mask)).astype(np.int64)
    owner = np.repeat(np.arange(len(bounds)), np.diff(np.concatenate([[0], bounds])))
    inside = owner[:len(place)] == owner[length - 1:]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    place = place[starts]
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1)) + 1
    first, last = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut, [len(starts)]]) - 1]
    anchor = place[np.concatenate([[0], cut])]
    snippet = mix(ranges(first, last + length) + (anchor - first).astype(np.uint64) * np.uint64(_P))
    return owner[first], hashes[anchor], snippet, anchor, first, last
