"""Suffix arrays by induced sorting, and permuted common prefixes, as numpy passes over buckets."""

from __future__ import annotations

import numpy as np

from terrasphere.llm.words import mix, powers, span_hash

#: Above so many names the order of the reduced string comes from rank doubling; a pass takes one step for each bucket.
RECURSE_NAMES = 2048


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one after them."""
    n = len(s)
    at = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = s[at] < s[at + 1]
    return small


def _by_letter(c: np.ndarray, letters: int) -> np.ndarray:
    """Stable order of small numbers; 16-bit ones are sorted by radix."""
    return np.argsort(c.astype(np.uint16) if letters <= 1 << 16 else c, kind="stable")


def _push(sa: np.ndarray, fill: np.ndarray, s: np.ndarray, found: np.ndarray, step: int) -> None:
    """Put suffixes into their buckets in the order given, from the fill marks up (1) or down (-1)."""
    if not len(found):
        return
    c = s[found]
    order = _by_letter(c, len(fill))
    c = c[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    count = np.diff(np.r_[first, len(c)])
    rank = np.arange(len(c)) - np.repeat(first, count)
    sa[fill[c] + rank if step > 0 else fill[c] - 1 - rank] = found[order]
    fill[c[first]] += step * count


def _induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Order of all suffixes from the sorted leftmost-smaller ones; inside a bucket, runs of its letter go in waves."""
    n = len(s)
    count = np.bincount(s)
    tail = np.cumsum(count)
    head = tail - count
    larger = np.bincount(s[~small], minlength=len(count))
    given = np.searchsorted(s[leftmost], np.arange(len(count) + 1))
    sa = np.full(n, -1, np.int32)
    letters = np.flatnonzero(count)
    fill = head.copy()
    for c in letters:
        done = head[c]
        while done < fill[c]:
            before = sa[done : fill[c]] - 1
            done = fill[c]
            before = before[before >= 0]
            same = before[(s[before] == c) & ~small[before]]
            sa[done : done + len(same)] = same
            fill[c] += len(same)
        before = np.concatenate([sa[head[c] : fill[c]], leftmost[given[c] : given[c + 1]]]) - 1
        before = before[before >= 0]
        _push(sa, fill, s, before[(s[before] != c) & ~small[before]], 1)
    fill = tail.copy()
    sa[0], fill[s[-1]] = n - 1, head[s[-1]]
    for c in letters[::-1]:
        done = tail[c]
        while done > fill[c]:
            before = sa[fill[c] : done][::-1] - 1
            done = fill[c]
            before = before[before >= 0]
            same = before[(s[before] == c) & small[before]]
            sa[done - len(same) : done] = same[::-1]
            fill[c] -= len(same)
        before = np.concatenate([sa[fill[c] : tail[c]][::-1], sa[head[c] : head[c] + larger[c]][::-1]]) - 1
        before = before[before >= 0]
        _push(sa, fill, s, before[(s[before] != c) & small[before]], -1)
    return sa


def _doubled(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes by doubling the length that ranks cover."""
    rank, k = s.astype(np.int64), 1
    while True:
        later = np.zeros(len(s), np.int64)
        later[:-k] = rank[k:] + 1
        pair = rank * (int(rank.max()) + 2) + later
        order = np.argsort(pair)
        new = np.r_[0, np.cumsum(pair[order][1:] != pair[order][:-1])]
        rank = np.empty(len(s), np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == len(s) - 1 or k >= len(s):
            return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of an integer string whose last letter is its only 0."""
    s = np.asarray(s, np.int32)
    if len(s) == 1:
        return np.zeros(1, np.int32)
    small = _types(s)
    leftmost = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    marked = np.zeros(len(s), bool)
    marked[leftmost] = True
    sa = _induce(s, small, leftmost[_by_letter(s[leftmost], int(s.max()) + 1)])
    ordered = sa[marked[sa]]
    # name the substrings between leftmost-smaller suffixes; equal ones follow each other
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s.astype(np.uint64) + np.uint64(0x9E3779B9)) * powers(len(s) + 1)[0][:-1], dtype=np.uint64, out=sums[1:])
    place = np.searchsorted(leftmost, ordered)
    end = np.r_[leftmost[1:], len(s) - 1][place] + 1
    h = span_hash(sums, ordered.astype(np.int64), end.astype(np.int64))
    name = np.r_[0, np.cumsum(h[1:] != h[:-1])]
    if name[-1] < len(ordered) - 1:
        reduced = np.empty(len(ordered), np.int32)
        reduced[place] = name
        ordered = leftmost[suffix_array(reduced) if name[-1] < RECURSE_NAMES else _doubled(reduced)]
    return _induce(s, small, ordered)


def common_prefixes(s: np.ndarray, sa: np.ndarray, sums: np.ndarray, fresh: np.ndarray, most: int) -> np.ndarray:
    """For each position (text order) the common prefix with the suffix before it in the array, up to `most`.

    A prefix whose two suffixes are preceded by the same letter is one shorter than that of the position before it;
    only the others are measured, by bisection over span hashes. Positions in `fresh` are measured too, so chains
    stay short. `sums` are the prefix sums of span_hash over s.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n - 1
    i = np.arange(n)
    measured = fresh | (i == 0) | (before == 0)
    rest = np.flatnonzero(~measured)
    measured[rest] = s[rest - 1] != s[before[rest] - 1]
    at = np.flatnonzero(measured)
    j = before[at]
    low, high = np.zeros(len(at), np.int64), np.minimum(most, n - np.maximum(at, j))
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = span_hash(sums, at, at + middle) == span_hash(sums, j, j + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    out = np.full(n, -1, np.int64)
    out[at] = low
    last = np.maximum.accumulate(np.where(measured, i, 0))
    return np.maximum(out[last] - (i - last), 0)
