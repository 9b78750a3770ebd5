"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified, leftmost-smaller (LMS) substrings are sorted by one induction, named and, unless the names are
all different, sorted by recursion; a second induction gives the array. All steps are linear. Small alphabets are
induced a bucket at a time in numpy; the recursion, with its large alphabets, goes element by element.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced by bucket.
BUCKETED = 600


def _classify(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S); the last is S."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    place = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(place[::-1])[::-1] if n > 1 else place
    return np.append(np.append(step, 1)[nxt] > 0, True)


def _induce_by_bucket(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    n = len(t)
    sa = np.full(n, -1, np.int64)
    size = np.bincount(t, minlength=sigma)
    end = np.cumsum(size)
    start = end - size
    chars = t[lms]
    by_char = lms[np.argsort(chars, kind="stable")]
    lms_end = np.cumsum(np.bincount(chars, minlength=sigma))
    lms_start = np.concatenate([[0], lms_end[:-1]])
    fill = start.copy()

    def put(found: np.ndarray, kind: bool, fill: np.ndarray, way: int) -> None:
        j = found - 1
        j = j[(found > 0) & (smaller[j] == kind)]
        if not len(j):
            return
        c = t[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        counts = np.bincount(c, minlength=sigma)
        rank = np.arange(len(j)) - (np.cumsum(counts) - counts)[c]
        sa[fill[c] + rank if way > 0 else fill[c] - 1 - rank] = j
        fill += way * counts

    for c in range(sigma):
        if not size[c]:
            continue
        done = start[c]
        while done < fill[c]:
            upto = fill[c]
            part, done = sa[done:upto], upto
            put(part, False, fill, 1)
        if lms_end[c] > lms_start[c]:
            put(by_char[lms_start[c]:lms_end[c]], False, fill, 1)
    larger = fill
    fill = end.copy()
    for c in range(sigma - 1, -1, -1):
        if not size[c]:
            continue
        done = end[c]
        while done > fill[c]:
            upto = fill[c]
            part, done = sa[upto:done][::-1], upto
            put(part, True, fill, -1)
        if larger[c] > start[c]:
            put(sa[start[c]:larger[c]][::-1], True, fill, -1)
    sa[0] = n - 1
    return sa


def _induce_by_element(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    n = len(t)
    size = np.bincount(t, minlength=sigma)
    ends = np.cumsum(size)
    text, kind, sa = t.tolist(), smaller.tolist(), [-1] * n
    fill = ends.tolist()
    for i in reversed(lms.tolist()):
        c = text[i]
        fill[c] -= 1
        sa[fill[c]] = i
    fill = (ends - size).tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not kind[j]:
            c = text[j]
            sa[fill[c]] = j
            fill[c] += 1
    fill = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and kind[j]:
            c = text[j]
            fill[c] -= 1
            sa[fill[c]] = j
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of symbols 0 to sigma - 1; the last symbol is 0 and the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _classify(t)
    is_lms = np.concatenate([[False], smaller[1:] & ~smaller[:-1]])
    lms = np.flatnonzero(is_lms)
    induce = _induce_by_bucket if sigma <= BUCKETED else _induce_by_element
    rough = induce(t, smaller, lms, sigma)
    ordered = rough[is_lms[rough]]
    # Equal neighbours among the sorted LMS substrings share a name.
    stop = np.empty(n, np.int64)
    stop[lms] = np.append(lms[1:], n - 1)
    a, b = ordered[:-1], ordered[1:]
    long_a, long_b = stop[a] - a, stop[b] - b
    alike = (long_a == long_b) & (a != n - 1) & (b != n - 1)
    live, offset = np.flatnonzero(alike), 0
    while len(live):
        same = t[a[live] + offset] == t[b[live] + offset]
        alike[live[~same]] = False
        live = live[same]
        offset += 1
        live = live[long_a[live] >= offset]
    names = np.empty(n, np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(~alike)])
    reduced = names[lms]
    if reduced.max() + 1 < len(lms):
        exact = lms[suffix_array(reduced, int(reduced.max()) + 1)]
    else:
        exact = ordered
    return induce(t, smaller, exact, sigma)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By text place: symbols that a suffix shares with the one before it in ``sa``, counted up to ``most``."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    word = np.zeros(n, np.uint64)  # four symbols of 16 bits
    wide = np.concatenate([t.astype(np.uint64), np.zeros(4, np.uint64)])
    for k in range(4):
        word |= wide[k:n + k] << np.uint64(16 * k)
    for offset in range(0, most, 4):
        i, j = live + offset, before[live] + offset
        ok = (i < n) & (j < n)
        live, i, j = live[ok], i[ok], j[ok]
        diff = word[i] ^ word[j]
        differs = diff != 0
        d = diff[differs]
        out[live[differs]] = offset + (d & np.uint64(0xFFFF) == 0).astype(int) + (d & np.uint64(0xFFFFFFFF) == 0) + (d & np.uint64(0xFFFFFFFFFFFF) == 0)
        live = live[~differs]
        out[live] = offset + 4
        if not len(live):
            break
    return np.minimum(out, most)
