"""Suffix arrays by induced sorting, vectorised by bucket, and permuted common prefixes.

``suffix_array`` follows the induced-sorting scheme of Nong, Zhang and Chan:
suffixes are classed as S (less than their successor) or L, the leftmost S ones
(LMS) seed the buckets, L suffixes are induced from left to right and S suffixes
from right to left. What scanning does one suffix at a time, this does a bucket
at a time: all entries of a bucket that are already placed induce their
predecessors together, until none falls into the same bucket.
"""

from __future__ import annotations

import numpy as np

#: Above so many symbols suffixes are induced one at a time; a step for each bucket would cost more. Both are linear.
MOST_BUCKETS = 2048


def classify(x: np.ndarray) -> np.ndarray:
    """True for S suffixes of ``x``, whose last symbol is its unique least."""
    n = len(x)
    differs = np.ones(n, bool)
    differs[:-1] = x[:-1] != x[1:]
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the end of a run of equal symbols
    return np.where(at == n - 1, True, x[at] < x[np.minimum(at + 1, n - 1)])


def _deal(pred: np.ndarray, sym: np.ndarray, into: list[list[np.ndarray]]) -> None:
    o = np.argsort(sym, kind="stable")
    sym, pred = sym[o], pred[o]
    cut = np.flatnonzero(sym[1:] != sym[:-1]) + 1
    at = [0, *cut.tolist(), len(sym)]
    for i, j in zip(at[:-1], at[1:], strict=True):
        if i < j:
            into[sym[i]].append(pred[i:j])


def induce(x: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes, induced from ``lms`` in order."""
    none = np.zeros(0, lms.dtype)
    small = x.dtype if x.dtype.itemsize <= 2 else (np.uint16 if sigma <= 1 << 16 else np.int64)
    seeds: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    _deal(lms, x[lms].astype(small), seeds)
    arrive: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    left: list[np.ndarray] = [none] * sigma

    def before(entries: np.ndarray, s_type: bool) -> tuple[np.ndarray, np.ndarray]:
        p = entries[entries > 0] - 1
        p = p[is_s[p] == s_type]
        return p, x[p].astype(small)

    for c in range(sigma):
        now, done = np.concatenate(arrive[c]) if arrive[c] else none, []
        arrive[c] = []
        while len(now):
            done.append(now)
            p, sym = before(now, False)
            same = sym == c
            _deal(p[~same], sym[~same], arrive)
            now = p[same]
        left[c] = np.concatenate(done) if done else none
        if seeds[c]:
            p, sym = before(np.concatenate(seeds[c]), False)
            _deal(p, sym, arrive)
    arrive = [[] for _ in range(sigma)]  # S suffixes, in descending order
    right: list[np.ndarray] = [none] * sigma
    for c in range(sigma - 1, -1, -1):
        now, done = np.concatenate(arrive[c]) if arrive[c] else none, []
        arrive[c] = []
        while len(now):
            done.append(now)
            p, sym = before(now, True)
            same = sym == c
            _deal(p[~same], sym[~same], arrive)
            now = p[same]
        right[c] = np.concatenate(done)[::-1] if done else none
        if len(left[c]):
            p, sym = before(left[c][::-1], True)
            _deal(p, sym, arrive)
    if not len(right[x[-1]]):
        right[x[-1]] = np.array([len(x) - 1], lms.dtype)  # the sentinel has no successor to be induced from
    return np.concatenate([y for c in range(sigma) for y in (left[c], right[c])])


def induce_singly(x: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """``induce`` for alphabets nearly as large as the text: two scans, one suffix at a time."""
    count = np.bincount(x, minlength=sigma)
    last = np.cumsum(count)
    head, tail = (last - count).tolist(), last.tolist()
    symbol, small, out = x.tolist(), is_s.tolist(), [-1] * len(x)
    for p in lms[::-1].tolist():
        c = symbol[p]
        tail[c] -= 1
        out[tail[c]] = p
    for i in range(len(x)):
        p = out[i] - 1
        if p >= 0 and not small[p]:
            c = symbol[p]
            out[head[c]] = p
            head[c] += 1
    tail = last.tolist()
    for i in range(len(x) - 1, -1, -1):
        p = out[i] - 1
        if p >= 0 and small[p]:
            c = symbol[p]
            tail[c] -= 1
            out[tail[c]] = p
    return np.array(out, lms.dtype)


def suffix_array(x: np.ndarray, sigma: int | None = None) -> np.ndarray:
    """Suffix array of ``x`` (non-negative integers); a sentinel is added below all symbols and left out of the result."""
    n = len(x)
    if n < 2:
        return np.arange(n)
    sigma = int(x.max()) + 2 if sigma is None else sigma + 1
    y = np.empty(n + 1, np.uint16 if sigma <= 1 << 16 else np.int64)
    y[:-1] = x
    y[:-1] += 1
    y[-1] = 0
    is_s = classify(y)
    is_lms = is_s.copy()
    is_lms[1:] &= ~is_s[:-1]
    is_lms[0] = False
    lms = np.flatnonzero(is_lms).astype(np.int32 if n < 1 << 31 else np.int64)
    sort = induce if sigma <= MOST_BUCKETS else induce_singly
    if len(lms) < 2:
        return sort(y, is_s, lms, sigma)[1:]
    order = sort(y, is_s, lms, sigma)
    order = order[is_lms[order]]  # LMS substrings in order
    number = np.empty(n + 1, lms.dtype)
    number[lms] = np.arange(len(lms))
    end = np.append(lms[1:], n)  # an LMS substring ends with the next LMS symbol
    size = end - lms + 1
    size[-1] = 1
    a, b = order[:-1], order[1:]
    la, lb = size[number[a]], size[number[b]]
    new = la != lb
    live, d = np.flatnonzero(~new), 0
    while len(live):
        live = live[la[live] > d]
        other = y[a[live] + d] != y[b[live] + d]
        new[live[other]] = True
        live, d = live[~other], d + 1
    names = np.zeros(len(lms), np.int64)
    names[1:] = np.cumsum(new)
    if names[-1] + 1 < len(lms):
        short = np.empty(len(lms), np.int64)
        short[number[order]] = names
        top = int(names[-1]) + 1
        order = lms[suffix_array(short, top)]
    return sort(y, is_s, order, sigma)[1:]


def permuted_common_prefix(x: np.ndarray, sa: np.ndarray, stop: int | None = None) -> np.ndarray:
    """For each position, its common prefix with the suffix before it in ``sa``; the symbol ``stop`` equals nothing.

    Only irreducible positions (another symbol before them than before their neighbour) are compared;
    along the text the value falls by at most one, so a running maximum gives the others.
    """
    n = len(x)
    left = np.empty(n + 1, np.int32)  # two views of the text in which ``stop`` and the end differ from everything
    left[:-1], left[-1] = x, -1
    right = left.copy()
    right[-1] = -2
    if stop is not None:
        left[left == stop], right[right == stop] = -3, -4
    prior = np.full(n, -1, sa.dtype)
    prior[sa[1:]] = sa[:-1]
    pos = np.arange(n, dtype=sa.dtype)
    known = prior >= 0
    todo = np.flatnonzero(known & ((pos == 0) | (prior == 0) | (left[pos - 1] != right[prior - 1]))).astype(sa.dtype)
    got = np.zeros(len(todo), sa.dtype)
    at, live, other, d = np.arange(len(todo)), todo, prior[todo], 0
    while len(at):
        go = (np.maximum(live, other) + d <= n) & (left[np.minimum(live + d, n)] == right[np.minimum(other + d, n)])
        got[at[~go]] = d
        at, live, other, d = at[go], live[go], other[go], d + 1
    reach = np.full(n, -1, np.int64)
    reach[todo] = got.astype(np.int64) + todo
    out = np.maximum(np.maximum.accumulate(reach) - pos, 0)
    out[~known] = 0
    return out
