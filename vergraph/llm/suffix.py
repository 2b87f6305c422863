"""Suffix arrays by induced sorting, and permuted common prefixes.

The text is a sequence of small integers.  Suffixes are classified as larger
(L) or smaller (S) than their successor; leftmost S suffixes (LMS) cut the
text into substrings, which are sorted and named; where names repeat, the
sequence of names is sorted by recursion.  From the order of the LMS suffixes
all others are induced, bucket by bucket: L suffixes from the left, S suffixes
from the right.  Each bucket is filled in waves, whole arrays at a time, so the
work is linear in the text and no step is taken per symbol.

Sequences of names have large alphabets with few suffixes a bucket.  There the
induction runs over all buckets at once: a suffix is placed by the rank of its
stretch up to the next LMS suffix, then by the rank of that suffix.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the end of the text counts as a smallest symbol."""
    n = len(t)
    s = np.zeros(n, bool)
    if n < 2:
        return s
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[following] > 0


def lms_positions(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _refine(name: np.ndarray, own: np.ndarray, value: np.ndarray) -> None:
    """Split groups of equal ``name`` (their place in the order) by ``value``,
    for the members ``own``; a group is among them as a whole or not at all."""
    order = np.lexsort((value, name[own]))
    own, value = own[order], value[order]
    group = name[own]
    new = np.ones(len(own), bool)
    new[1:] = group[1:] != group[:-1]
    part = new.copy()
    part[1:] |= value[1:] != value[:-1]
    at = np.arange(len(own))
    first = np.maximum.accumulate(np.where(new, at, 0))
    inner = np.maximum.accumulate(np.where(part, at, 0))
    name[own] = group + inner - first


def _shared(name: np.ndarray) -> np.ndarray:
    """Which members are not alone in their group."""
    return np.bincount(name, minlength=len(name))[name] > 1


def _dense(name: np.ndarray) -> np.ndarray:
    used = np.zeros(len(name) + 1, np.int64)
    used[name] = 1
    return (np.cumsum(used) - 1)[name]


def _grouped(key: np.ndarray) -> np.ndarray:
    """The place of each key's first equal in the sorted order."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.maximum.accumulate(np.where(np.append(True, k[1:] != k[:-1]), np.arange(len(k)), 0))
    out = np.empty(len(k), np.int64)
    out[order] = first
    return out


def order_of_names(t: np.ndarray) -> np.ndarray:
    """Rank of every suffix of a sequence of names (recursive)."""
    m = len(t)
    if m == 0:
        return np.zeros(0, np.int64)
    s = classify(t)
    lms = lms_positions(s)
    bound = np.append(lms, m)  # the end is the last LMS suffix
    nxt = bound[np.searchsorted(bound, np.arange(m), side="right")]
    code = np.append((t.astype(np.int64) << 1 | s) + 1, 0)
    # a suffix's stretch: its (symbol, type) pairs up to the next LMS, that one included
    name = _grouped(code[:-1] * (int(code.max()) + 1) + code[1:])
    by_code = np.sort(code[:-1])
    alone = np.searchsorted(by_code, code)  # place of a single symbol
    width = 2
    shared = _shared(name)
    while True:
        own = np.flatnonzero(shared & (np.arange(m) + width <= nxt))
        if not len(own):
            break
        j = own + width
        end = j == nxt[own]
        value = np.where(end, alone[j], name[np.minimum(j, m - 1)])
        _refine(name, own, value)
        shared[own] = _shared(name)[own]
        width *= 2
    if not shared.any():
        return name
    rank = np.full(m + 1, -1, np.int64)
    if len(lms):
        sub = _grouped(name[lms])
        dense = _dense(sub)
        rank[lms] = dense if int(dense.max()) + 1 == len(lms) else order_of_names(dense)
    own = np.flatnonzero(shared)
    _refine(name, own, rank[nxt[own]])
    return name


PACKED = 6  # symbols of up to ten bits in a 64-bit word


def sort_lms(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The LMS positions in the order of their suffixes."""
    n, m = len(t), len(lms)
    if m < 2:
        return lms
    code = np.zeros(n + PACKED + 1, np.int64)
    code[:n] = (t.astype(np.int64) << 1 | s) + 1
    end = np.append(lms[1:], n)

    def word(own, at):
        w = np.zeros(len(own), np.int64)
        for i in range(PACKED):
            p = lms[own] + at + i
            w = w << 10 | np.where(p <= end[own], code[np.minimum(p, n)], 0)
        return w

    name = _grouped(word(np.arange(m), 0))
    at, length = PACKED, end - lms + 1
    shared = _shared(name)
    while True:
        own = np.flatnonzero(shared & (length > at))
        if not len(own):
            break
        _refine(name, own, word(own, at))
        shared[own] = _shared(name)[own]
        at += PACKED
    if shared.any():
        name = order_of_names(_dense(name))
    out = np.empty(m, np.int64)
    out[name] = lms
    return out


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of all suffixes in order; ``t`` holds values under ``symbols``
    (at most 511)."""
    n = len(t)
    s = classify(t)
    lms = lms_positions(s)
    seeds = sort_lms(t, s, lms)
    sizes = np.bincount(t, minlength=symbols)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    larger = np.bincount(t[~s], minlength=symbols)  # L suffixes come first in a bucket
    sa = np.full(n, -1, np.int64)
    kind = np.uint8 if symbols <= 256 else np.uint16
    small = t.astype(kind)

    # the LMS suffixes of each bucket, in order, used as seeds of the L pass
    seed_of = small[seeds]
    seed_first = np.searchsorted(seed_of, np.arange(symbols + 1))

    def induce(found: np.ndarray, place: np.ndarray, s_wanted: bool, back: bool) -> None:
        """Append the predecessors of ``found`` that have the wanted type to their buckets."""
        j = found - 1
        if found.size and found.min() == 0:
            j = j[j >= 0]
        j = j[s[j] == s_wanted]
        if not len(j):
            return
        c = small[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        count = np.diff(np.append(first, len(c)))
        at = np.arange(len(c)) - np.repeat(first, count)
        b = c[first]
        if back:
            sa[place[c] - 1 - at] = j
            place[b] -= count
        else:
            sa[place[c] + at] = j
            place[b] += count

    head = starts.copy()
    if n:
        induce(np.array([n]), head, False, False)  # the last suffix, before the end
    for c in np.flatnonzero(sizes):
        done = starts[c]
        while done < head[c]:
            wave, done = sa[done : head[c]], head[c]
            induce(wave, head, False, False)
        if seed_first[c] < seed_first[c + 1]:
            induce(seeds[seed_first[c] : seed_first[c + 1]], head, False, False)
    tail = ends.copy()
    for c in np.flatnonzero(sizes)[::-1]:
        done = ends[c]
        while done > tail[c]:
            wave, done = sa[tail[c] : done][::-1], tail[c]
            induce(wave, tail, True, True)
        if larger[c]:
            induce(sa[starts[c] : starts[c] + larger[c]][::-1], tail, True, True)
    return sa


def permuted_lcp(t: np.ndarray, sa: np.ndarray, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each position of a text of bytes, in text order: the position before
    it in the suffix array (-1 for the first) and the length of their common
    prefix.  With ``stop``, common prefixes end before that symbol.  Only
    irreducible values (whose predecessors differ) are compared, eight bytes at
    a time; the others are one less than the value before."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    limit = np.full(n, n)  # where a common prefix from here must end
    if stop is not None:
        limit[t == stop] = i[t == stop]
        limit = np.minimum.accumulate(limit[::-1])[::-1]
    same = np.zeros(n, bool)
    same[1:] = (before[1:] > 0) & (t[:-1] == t[before[1:] - 1]) & (before[:-1] == before[1:] - 1)
    if stop is not None:
        same[1:] &= t[:-1] != stop
    own = np.flatnonzero((before >= 0) & ~same)
    a, b = own, before[own]
    most = np.minimum(limit[a] - a, limit[b] - b)
    raw = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), np.uint64, raw.tobytes(), strides=(1,))
    length = np.zeros(len(own), np.int64)
    alive = np.flatnonzero(most > 0)
    for _ in range(64):
        if not len(alive):
            break
        x = words[a[alive] + length[alive]] ^ words[b[alive] + length[alive]]
        ended = np.flatnonzero(x)
        low = x[ended] & (~x[ended] + np.uint64(1))
        equal = np.zeros(len(ended), np.int64)
        for k in range(1, 8):
            equal += low >= np.uint64(1 << 8 * k)
        length[alive[ended]] += equal
        alive = alive[x == 0]
        length[alive] += 8
        alive = alive[length[alive] < most[alive]]
    for k in alive.tolist():  # long ones, a stretch at a time
        x, y, step = int(a[k]), int(b[k]), 4096
        while length[k] < most[k]:
            at, end = int(length[k]), int(min(length[k] + step, most[k]))
            unequal = np.flatnonzero(t[x + at : x + end] != t[y + at : y + end])
            if len(unequal):
                length[k] = at + unequal[0]
                break
            length[k], step = end, step * 2
    lcp = np.zeros(n, np.int64)
    lcp[own] = np.minimum(length, most)
    last = np.maximum.accumulate(np.where(same, -1, i))
    chained = np.flatnonzero(same)
    lcp[chained] = np.maximum(lcp[last[chained]] - (chained - last[chained]), 0)
    return before, lcp
