"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classed as falling (greater than the next suffix) or rising. A rising suffix after a
falling one is leftmost-smaller. Sorting those suffixes is enough: the others follow by induction, the
falling ones in one pass over the buckets upwards, the rising ones in one downwards. The
leftmost-smaller suffixes are sorted by their substrings up to the next of their kind, which are induced
the same way, named by rank, and sorted as a shorter string recursively where names repeat.

A string here ends with its only least character, 0. Induction goes by array operations on whole
buckets, each suffix once a pass. That pays while there are few buckets; a shorter string of more
than ``BUCKETS`` names ends the recursion and is sorted by doubling ranks.
"""

from __future__ import annotations

import numpy as np

BUCKETS = 2048


def rising(t: np.ndarray) -> np.ndarray:
    """True where a suffix is less than the next one. The last is rising by definition."""
    step = np.sign(np.diff(t.astype(np.int64)))
    decides = np.flatnonzero(step)  # the first unequal neighbour from here on
    at = np.searchsorted(decides, np.arange(len(step)))
    return np.append(step[decides[np.minimum(at, len(decides) - 1)]] > 0, True) if len(decides) else np.ones(len(t), bool)


def induced(t: np.ndarray, up: np.ndarray, counts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes from ``seeds``, the leftmost-smaller ones in order. A step takes as
    many buckets together as induce nothing into one another."""
    n, used = len(t), np.flatnonzero(counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    order = np.full(n, -1, np.int32)
    seeded = np.bincount(t[seeds], minlength=len(counts))
    seed_places = np.repeat(ends - np.cumsum(seeded), seeded) + np.arange(len(seeds))  # seeds come by first character
    order[seed_places] = seeds

    def groups(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        by = np.argsort(chars, kind="stable")
        chars = chars[by]
        first = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
        return by, chars[first], first, np.diff(np.append(first, len(chars)))

    def put_up(before: np.ndarray, chars: np.ndarray) -> None:
        if len(before):
            by, char, first, sizes = groups(chars)
            order[np.repeat(head[char] - first, sizes) + np.arange(len(by))] = before[by]
            head[char] += sizes

    def put_down(before: np.ndarray, chars: np.ndarray) -> None:
        if len(before):
            by, char, first, sizes = groups(chars)
            order[np.repeat(tail[char] + first, sizes) - 1 - np.arange(len(by))] = before[by]
            tail[char] -= sizes

    def falling_before(source: np.ndarray) -> np.ndarray:
        before = source[source > 0] - 1
        return before[~up[before]]

    def rising_before(source: np.ndarray) -> np.ndarray:
        before = source[source > 0] - 1
        return before[up[before]]

    head, i, width = starts.copy(), 0, 1
    while i < len(used):
        j = min(i + width, len(used))
        low, c = starts[used[i]], used[i]
        if j > i + 1:
            before = falling_before(order[low : ends[used[j - 1]]])
            chars = t[before]
            clash = chars[chars <= used[j - 1]]
            if len(clash):
                j = int(np.searchsorted(used, clash.min()))
                if j > i + 1:
                    before = falling_before(order[low : starts[used[j]]])
                    chars = t[before]
            width = 2 * (j - i) if len(clash) else 2 * width
        if j <= i + 1:
            at = low
            while at < head[c]:
                at, done = head[c], at
                before = falling_before(order[done:at])
                put_up(before, t[before])
            before = falling_before(order[ends[c] - seeded[c] : ends[c]])
            put_up(before, t[before])
            j, width = i + 1, max(2, width)
        else:
            put_up(before, chars)
        i = j

    order[seed_places] = -1
    order[0] = n - 1
    tail, i, width = ends.copy(), len(used), 1
    while i > 0:
        j = max(i - width, 0)
        high, c = ends[used[i - 1]], used[i - 1]
        if j < i - 1:
            before = rising_before(order[starts[used[j]] : high][::-1])
            chars = t[before]
            clash = chars[chars >= used[j]]
            if len(clash):
                j = int(np.searchsorted(used, clash.max())) + 1
                if j < i - 1:
                    before = rising_before(order[starts[used[j]] : high][::-1])
                    chars = t[before]
            width = 2 * (i - j) if len(clash) else 2 * width
        if j >= i - 1:
            at = high
            while at > tail[c]:
                at, done = tail[c], at
                before = rising_before(order[at:done][::-1])
                put_down(before, t[before])
            before = rising_before(order[starts[c] : head[c]][::-1])
            put_down(before, t[before])
            j, width = i - 1, max(2, width)
        else:
            put_down(before, chars)
        i = j
    order[0] = n - 1
    return order


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of the suffixes of ``t`` (its only 0 at the end) in order."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    t = t.astype(np.uint16 if alphabet <= 1 << 16 else np.int32)  # short ones sort by radix
    up = rising(t)
    counts = np.bincount(t, minlength=alphabet)
    least = np.flatnonzero(up[1:] & ~up[:-1]).astype(np.int32) + 1  # leftmost-smaller, in text order
    if len(least) < 2:
        return induced(t, up, counts, least)
    is_least = np.zeros(n, bool)
    is_least[least] = True
    order = induced(t, up, counts, least[np.argsort(t[least], kind="stable")])
    by_substring = order[is_least[order]]
    rank = np.zeros(n, np.int32)
    rank[least] = np.arange(len(least))
    long = np.append(np.diff(least), 0)[rank[by_substring]]  # of each, to the next; the last has none
    a, b = by_substring[:-1], by_substring[1:]
    fresh = long[:-1] != long[1:]
    open_, k = np.flatnonzero(~fresh), 0
    while len(open_):  # compare substrings of one length, character by character
        differ = t[a[open_] + k] != t[b[open_] + k]
        fresh[open_[differ]] = True
        open_ = open_[~differ & (long[:-1][open_] > k)]
        k += 1
    names = np.append(0, np.cumsum(fresh))
    if names[-1] + 1 == len(least):
        seeds = by_substring
    else:
        shorter = np.empty(len(least), np.int32)
        shorter[rank[by_substring]] = names
        sort = suffix_array if names[-1] < BUCKETS else by_ranks
        seeds = least[sort(shorter, int(names[-1]) + 1)]
    return induced(t, up, counts, seeds)


def by_ranks(t: np.ndarray, alphabet: int) -> np.ndarray:
    """The same order from ranks of the first character, of the first two, four and so on."""
    n, rank, k = len(t), t.astype(np.int64), 1
    while True:
        key = rank * (max(n, alphabet) + 1)
        key[: max(0, n - k)] += rank[k:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        if new[order[-1]] == n - 1:
            return order.astype(np.int32)
        rank, k = new, 2 * k


def permuted_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, by its place in the text, the length it shares with the suffix before it in
    ``order``, up to ``most``. Where the characters before both are the same the length is one less than
    that of the place before; only the other places compare characters."""
    n = len(t)
    before = np.empty(n, np.int32)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (t[:-1] == t[before[1:] - 1])
    at = np.flatnonzero(~follows & (before >= 0))
    shared = np.zeros(n, np.int32)
    a, b, k = at, before[at], 0
    live = np.arange(len(at))
    lengths = np.zeros(len(at), np.int32)
    while len(live):  # ends within t, as its last character is its only 0
        same = t[a[live] + k] == t[b[live] + k]
        live = live[same]
        k += 1
        lengths[live] = k
    shared[at] = lengths
    # carried: the length at the last compared place less the steps since
    reach = np.where(~follows, shared + np.arange(n), -1)
    last = np.maximum.accumulate(np.where(~follows, np.arange(n), 0))
    return np.minimum(np.maximum(reach[last] - np.arange(n), 0), most)
