"""Suffix arrays by induced sorting, and permuted common prefixes.

On each level the leftmost-smaller substrings are sorted directly, several symbols of all of them at a
time, and named; where names repeat, the text of names is sorted by the same steps. Then all suffixes
are induced once. Level 0, over bytes, induces with array operations: the suffixes that begin with one
value are a bucket, and a bucket's entries send their predecessors to later buckets all at once. Deeper
levels, over names, are a third as long or less and run entry by entry.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet that is induced bucket by bucket.
_BUCKETS = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S); the last suffix is larger (L), the end being least."""
    n = len(s)
    is_s = np.zeros(n, bool)
    step = np.sign(np.diff(s.astype(np.int64)))  # 1: next is larger, so S
    if n > 1:
        # of a run of equal values, the type is that at its end
        at = np.where(step != 0, np.arange(n - 1), n - 1)
        at = np.minimum.accumulate(at[::-1])[::-1]
        decided = at < n - 1
        is_s[:-1] = np.where(decided, step[np.minimum(at, n - 2)] > 0, False)
    return is_s


def _induce(s: np.ndarray, is_s: np.ndarray, counts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The array with all suffixes in induced order, given the leftmost-smaller ones in theirs."""
    n, sigma = len(s), len(counts)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.full(n, -1, np.int64)
    head = begins.copy()
    seed_bucket = s[seeds]
    seed_edge = np.searchsorted(seed_bucket, np.arange(sigma + 1))

    def send(entries: np.ndarray, larger: bool) -> np.ndarray | None:
        """Predecessors of ``entries`` of the wanted type, in order."""
        before = entries[entries > 0] - 1
        return before[is_s[before] != larger] if larger else before[is_s[before]]

    def place_front(items: np.ndarray) -> None:
        c = s[items]
        order = np.argsort(c, kind="stable")
        items, c = items[order], c[order]
        edge = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]])
        for v, a, b in zip(c[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()):
            sa[head[v] : head[v] + b - a] = items[a:b]
            head[v] += b - a

    last = n - 1
    if not is_s[last]:
        place_front(np.array([last]))
    for c in np.flatnonzero(counts).tolist():
        at = begins[c]
        while at < head[c]:
            to = head[c]
            items = send(sa[at:to], True)
            at = to
            if len(items):
                place_front(items)
        items = send(seeds[seed_edge[c] : seed_edge[c + 1]], True)
        if len(items):
            place_front(items)
    larger_end = head.copy()
    tail = ends.copy()

    def place_back(items: np.ndarray) -> None:
        """``items`` come from right to left: the first goes last."""
        c = s[items]
        order = np.argsort(c, kind="stable")
        items, c = items[order], c[order]
        edge = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]])
        for v, a, b in zip(c[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()):
            sa[tail[v] - (b - a) : tail[v]] = items[a:b][::-1]
            tail[v] -= b - a

    for c in np.flatnonzero(counts)[::-1].tolist():
        at = ends[c]
        while at > tail[c]:
            to = tail[c]
            items = send(sa[to:at][::-1], False)
            at = to
            if len(items):
                place_back(items)
        items = send(sa[begins[c] : larger_end[c]][::-1], False)
        if len(items):
            place_back(items)
    return sa


def _induce_each(s: np.ndarray, is_s: np.ndarray, counts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same, entry by entry. A list that grows ahead of its reader serves as the scan."""
    n = len(s)
    ends = np.cumsum(counts)
    # bucket that an entry's predecessor goes to, by the predecessor's type; -1: to none
    larger, smaller = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    larger[1:] = np.where(is_s[:-1], -1, s[:-1])
    smaller[1:] = np.where(is_s[:-1], s[:-1], -1)
    to_front, to_back = larger.tolist(), smaller.tolist()
    sa = np.full(n, -1, np.int64)
    bucket = s[seeds]  # the seeds come bucket by bucket: each bucket's lie at its end
    size = np.bincount(bucket, minlength=len(counts))
    sa[ends[bucket] - size[bucket] + np.arange(len(seeds)) - (np.cumsum(size) - size)[bucket]] = seeds
    scan, head = sa.tolist(), (ends - counts).tolist()
    if not is_s[n - 1]:
        c = int(s[n - 1])
        scan[head[c]] = n - 1
        head[c] += 1
    for i in scan:
        if i > 0:
            c = to_front[i]
            if c >= 0:
                k = head[c]
                scan[k] = i - 1
                head[c] = k + 1
    scan.reverse()  # now from right to left, and tails become heads
    head = (n - ends).tolist()
    for i in scan:
        if i > 0:
            c = to_back[i]
            if c >= 0:
                k = head[c]
                scan[k] = i - 1
                head[c] = k + 1
    scan.reverse()
    return np.array(scan, np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``s`` (values from 0) in order; a shorter prefix comes first."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    counts = np.bincount(s)
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    large = len(counts) > _BUCKETS

    def induced(seeds: np.ndarray) -> np.ndarray:
        if not large:
            return _induce(s, is_s, counts, seeds)
        return _induce_each(s, is_s, counts, seeds)

    if len(lms) > 1:
        names, distinct = _name(s, is_s, lms)
        order = np.argsort(names, kind="stable") if distinct == len(lms) else suffix_array(names)
        lms = lms[order]
    return induced(lms)


def _name(s: np.ndarray, is_s: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, by order, of the leftmost-smaller substrings that begin at ``places``; how many differ.

    Symbols are compared with their types, as many at a time as fit a word. A substring ends with the
    next one's first symbol; the last runs to the end, which is less than any symbol.
    """
    n, m = len(s), len(places)
    code = s.astype(np.int64) * 2 + is_s + 1
    bits = int(code.max()).bit_length()
    each = 63 // bits
    length = np.append(places[1:] - places[:-1] + 1, n - places[-1])
    rank, live, step = np.zeros(m, np.int64), np.arange(m), 0
    while len(live):
        word = np.zeros(len(live), np.int64)
        for k in range(step, step + each):
            word = word << bits | np.where(k < length[live], code[np.minimum(places[live] + k, n - 1)], 0)
        old = rank[live]
        order = np.lexsort((word, old)) if step else np.argsort(word, kind="stable")
        live, word, old = live[order], word[order], old[order]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        new = group.copy()
        new[1:] |= word[1:] != word[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(live)))
        at = np.maximum.accumulate(np.where(group, np.arange(len(live)), 0))[begin]
        rank[live] = np.repeat(old[begin] + begin - at, size)
        step += each
        more = (size > 1) & (np.maximum.reduceat(length[live], begin) > step)
        live = live[np.repeat(more, size)]
    kinds, names = np.unique(rank, return_inverse=True)
    return names, len(kinds)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Per position, how many values its suffix shares with the one before it in ``sa``, ``most`` at most.

    Where the values before both suffixes are equal the figure is its left neighbour's less one; the
    others are measured, all at once, value by value.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    fresh = np.ones(n, bool)
    i = place[1:]
    ok = (before[1:] > 0) & (before[:-1] >= 0)
    ok[ok] = (s[i[ok] - 1] == s[before[1:][ok] - 1])
    fresh[1:] = ~ok
    start = np.flatnonzero(fresh & (before >= 0))
    measured = np.zeros(n, np.int64)
    # a reducible run may take a capped figure down below ``most``: measure as far as its run needs
    runs = np.flatnonzero(fresh)
    run_length = np.zeros(n, np.int64)
    run_length[runs] = np.diff(np.append(runs, n))
    packed = np.full(4 * n + 8, 0xFF, np.uint8)
    if s.max(initial=0) < 0xFF:  # a byte a value: eight values are compared at once
        each, packed = 8, np.concatenate([s.astype(np.uint8), np.full(16, 0xFF, np.uint8)])
    else:
        each = 2
        packed[: 4 * n] = s.astype("<u4").view(np.uint8)
    width = 8 // each
    words = np.ndarray((n + 1,), "<u8", packed.tobytes() + bytes(16), 0, (width,))
    live, step = start, 0
    while len(live):
        a, b = live + step, before[live] + step
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, each, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // (8 * width))
        equal = np.minimum(equal, np.maximum(0, n - np.maximum(a, b)))
        reached = step + equal
        done = (equal < each) | (reached >= most + run_length[live] - 1)
        measured[live[done]] = reached[done]
        live = live[~done]
        step += each
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    out = measured[last] - (place - last)
    out[before < 0] = 0
    return np.minimum(np.maximum(out, 0), most)
