"""Suffix array of a text block by induced sorting, and its permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than their right neighbour.  The leftmost-smaller
ones (smaller, after a larger one) start the substrings that are sorted first, by inducing from an
arbitrary order; equal substrings get equal names, and when names repeat, the suffixes of the
sequence of names are sorted by doubling.  From the sorted leftmost-smaller suffixes, one scan up and one scan down
over the buckets induce the order of all suffixes in linear time.

On the small alphabet of the text a scan handles a bucket at a time: what its entries induce is
dealt to the other buckets at once, and what they induce in their own bucket is the next wave.  Names
are too many for buckets: each doubling is one sort of the names' suffixes that still tie.
"""

from __future__ import annotations

import numpy as np


def types_of(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; ``s`` ends in a unique smallest symbol."""
    n = len(s)
    smaller = np.ones(n, dtype=bool)
    if n > 1:
        step = s[:-1] != s[1:]
        at = np.where(step, np.arange(n - 1), n)
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        smaller[:-1] = s[nearest] < s[np.minimum(nearest + 1, n - 1)]
    return smaller


def _deal(sa: np.ndarray, s: np.ndarray, items: np.ndarray, place: np.ndarray, step: int) -> None:
    """Append items to the buckets of their symbols, in order; ``place`` is each bucket's next slot."""
    symbols = s[items]
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order].astype(np.int64)
    counts = np.bincount(symbols, minlength=len(place))
    first = np.cumsum(counts) - counts
    sa[place[symbols] + step * (np.arange(len(items)) - first[symbols])] = items[order]
    place += step * counts


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes from leftmost-smaller ones given bucket by bucket in order."""
    n, size = len(s), len(heads)
    sa = np.full(n, -1, dtype=np.int64)
    counts = np.bincount(s[lms], minlength=size)
    stops = np.cumsum(counts)
    before = np.concatenate((smaller[-1:], smaller[:-1]))  # type of the suffix one to the left
    up = heads.copy()
    for c in range(size):
        at = heads[c]
        while at < up[c]:
            wave = sa[at : up[c]]
            at = up[c]
            wave = wave[(wave > 0) & ~before[wave]] - 1
            if len(wave):
                _deal(sa, s, wave, up, 1)
        wave = lms[stops[c] - counts[c] : stops[c]]
        wave = wave[wave > 0] - 1
        if len(wave):
            _deal(sa, s, wave, up, 1)
    down = ends - 1
    for c in range(size - 1, -1, -1):
        at = ends[c] - 1
        while at > down[c]:
            wave = sa[down[c] + 1 : at + 1][::-1]
            at = down[c]
            wave = wave[(wave > 0) & before[wave]] - 1
            if len(wave):
                _deal(sa, s, wave, down, -1)
        wave = sa[heads[c] : up[c]][::-1]
        wave = wave[(wave > 0) & before[wave]] - 1
        if len(wave):
            _deal(sa, s, wave, down, -1)
    sa[0] = n - 1  # the last symbol is alone in the first bucket
    return sa


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Equal names for equal substrings, given leftmost-smaller positions in sorted order."""
    following = np.empty(len(s), dtype=np.int64)
    following[lms[:-1]] = lms[1:]
    following[lms[-1]] = lms[-1]
    length = following[order] - order + 1
    same = length[1:] == length[:-1]
    alive = np.flatnonzero(same)
    t = 0
    while len(alive):
        equal = s[order[alive] + t] == s[order[alive + 1] + t]
        same[alive[~equal]] = False
        alive = alive[equal]
        t += 1
        alive = alive[length[alive] > t]
    name = np.concatenate(([0], np.cumsum(~same)))
    out = np.empty(len(s), dtype=np.int64)
    out[order] = name
    return out[lms]


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence of names (its last is unique and smallest).

    Suffixes equal in their first ``reach`` names are a group, ranked by its first slot in the order.  The rank of
    the suffix ``reach`` further on splits a group by twice as many names, until every group is one suffix.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    key = names[order]
    slots = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    reach = 1
    while True:
        edge = np.concatenate(([True], key[1:] != key[:-1], [True]))
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(edge[:-1], np.arange(len(key)), 0))]
        slots = slots[~(edge[:-1] & edge[1:])]  # of groups that hold more than one
        if not len(slots):
            return order
        # The last name is unique, so a suffix that equals another in ``reach`` names goes on after them.
        items = order[slots]
        key = rank[items] * n + rank[items + reach]
        turn = np.argsort(key)
        order[slots], key = items[turn], key[turn]
        reach *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions in suffix order; ``s`` are small integers that end in a unique smallest 0."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].copy()
    s = s.astype(np.uint16)
    smaller = types_of(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    heads = ends - counts
    if len(lms) > 1:
        rough = _induce(s, smaller, lms[np.argsort(s[lms], kind="stable")], heads, ends)
        marked = np.zeros(n, dtype=bool)
        marked[lms] = True
        lms = lms[_sort_names(_names(s, lms, rough[marked[rough]]))]
    return _induce(s, smaller, lms, heads, ends)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, most: int, breaks: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix sorted before it, in text order.

    Only irreducible positions (whose left neighbours differ, or listed in ``breaks``) are compared;
    any other value is one less than that of the position before.  Exact for values below ``most``
    minus the distance to the last break.
    """
    n = len(s)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n - 1
    left, left_before = np.arange(n) - 1, before - 1
    irreducible = (left < 0) | (left_before < 0) | (s[left] != s[left_before])
    irreducible[breaks] = True
    irreducible[sa[0]] = True
    a = np.flatnonzero(irreducible)
    b = before[a]
    padded = np.concatenate((s.astype("<u2"), np.array([0xFFFF, 0xFFFE, 0xFFFD, 0xFFFC], dtype="<u2")))
    words = np.ndarray((n + 1,), dtype="<u8", buffer=padded.tobytes(), strides=(2,))
    length = np.zeros(len(a), dtype=np.int64)
    alive = np.flatnonzero(a != b)
    while len(alive):
        x, y = a[alive] + length[alive], b[alive] + length[alive]
        inside = (x < n) & (y < n)
        alive, x, y = alive[inside], x[inside], y[inside]
        diff = words[x] ^ words[y]
        low = diff & (~diff + np.uint64(1))
        more = np.where(diff == 0, 4, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 16)
        length[alive] += more
        alive = alive[(diff == 0) & (length[alive] < most)]
    out = np.zeros(n, dtype=np.int64)
    out[a] = length
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    return np.maximum(out[last] - (np.arange(n) - last), 0)
