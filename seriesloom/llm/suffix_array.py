"""Suffix arrays by induced sorting, and permuted common prefixes, vectorised over numpy arrays."""

from __future__ import annotations

import numpy as np

#: Ends each text inside a joined string; never a byte of UTF-8 (texts are shifted up by one).
END_OF_TEXT = 255


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One string of all texts (bytes + 1), each closed by END_OF_TEXT, all by a sentinel 0; and the start of each."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    joined = np.frombuffer(b"".join(t + b"\xfe" for t in texts) + b"\xff", np.uint8) + np.uint8(1)
    return joined, np.cumsum(sizes) - sizes


def classify(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S-type flags (smaller than the next suffix) and the positions of leftmost S-type ones, in text order."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int16) - s[:-1].astype(np.int16))
    at = np.where(step != 0, np.arange(n - 1), n - 2)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = step[at] > 0
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from leftmost-S suffixes given in order within each first character.

    One pass over the buckets from the left sorts the larger suffixes, one from the right
    the smaller ones. A bucket is worked off in waves: each wave takes the entries that
    the last one added and puts their left neighbours into their buckets, all at once.
    """
    n, symbols = len(s), 256
    counts = np.bincount(s, minlength=symbols)
    tails = np.cumsum(counts)
    heads = tails - counts
    sa = np.zeros(n, np.int32)
    first = s[lms]
    ends = np.cumsum(np.bincount(first, minlength=symbols))
    present = np.flatnonzero(counts)

    free = heads.copy()
    for c in present:
        at = heads[c]
        while at < free[c]:
            upto = free[c]
            _put(s, sa, free, sa[at:upto], small, False)
            at = upto
        own = lms[ends[c - 1] if c else 0 : ends[c]]
        if len(own):
            _put(s, sa, free, own, small, False)
    larger_end, free = free, tails.copy()
    sa[0] = n - 1
    for c in present[::-1]:
        at = tails[c]
        while free[c] < at:
            downto = free[c]
            _put(s, sa, free, sa[downto:at][::-1], small, True)
            at = downto
        if heads[c] < larger_end[c]:
            _put(s, sa, free, sa[heads[c] : larger_end[c]][::-1], small, True)
    return sa


def _put(s: np.ndarray, sa: np.ndarray, free: np.ndarray, entries: np.ndarray, small: np.ndarray, down: bool) -> None:
    left = entries[entries > 0] - 1
    left = left[small[left] == down]
    if not len(left):
        return
    symbols = s[left]
    order = np.argsort(symbols, kind="stable")
    left, symbols = left[order], symbols[order]
    counts = np.bincount(symbols, minlength=len(free))
    rank = np.arange(len(left)) - (np.cumsum(counts) - counts)[symbols]
    if down:
        sa[free[symbols] - 1 - rank] = left
        free -= counts
    else:
        sa[free[symbols] + rank] = left
        free += counts


def name_substrings(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Equal numbers for equal leftmost-S substrings, rising in their order; in text order."""
    place = np.zeros(len(s), np.int32)
    place[lms] = np.arange(len(lms))
    until = np.append(lms[1:], lms[-1])
    sizes = (until - lms)[place[ordered]]
    same = np.zeros(len(ordered), bool)
    at = np.flatnonzero(sizes[1:] == sizes[:-1]) + 1
    a, b, size = ordered[at - 1], ordered[at], sizes[at]
    live, t = np.arange(len(at)), 0
    equal = np.ones(len(at), bool)
    while len(live):
        ok = s[a[live] + t] == s[b[live] + t]
        equal[live[~ok]] = False
        live = live[ok]
        live = live[size[live] > t]
        t += 1
    same[at] = equal
    names = np.empty(len(lms), np.int64)
    names[place[ordered]] = np.cumsum(~same)
    return names


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``s``, exact for the first ``depth`` characters at least.

    Leftmost-S substrings are sorted by inducing and named; where names repeat, the
    string of names, at most half as long, is sorted in turn by doubling the length
    compared until all ranks differ or ``depth`` characters are covered (a name spans
    two at least); then all suffixes are induced from it.
    """
    small, lms = classify(s)
    by_symbol = lms[np.argsort(s[lms], kind="stable")]
    rough = induce(s, small, by_symbol)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    ranks = name_substrings(s, lms, ordered)
    width = 1
    while width * 2 <= depth + 4 and ranks.max(initial=0) < len(ranks):
        follow = np.zeros_like(ranks)
        follow[: len(ranks) - width] = ranks[width:]
        ranks = np.unique(ranks * (ranks.max() + 1) + follow, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    return induce(s, small, lms[np.argsort(ranks, kind="stable")])


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the position of the suffix before it in order, and the length they share.

    A length that follows from its left neighbour's (both suffixes preceded by the same
    character) is one less than that; only the others are compared.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (before[:-1] >= 0)
    at = np.flatnonzero(follows)
    follows[at] = s[at - 1] == s[before[at] - 1]
    # the neighbour must have been compared with the very position before ours
    at = np.flatnonzero(follows)
    follows[at] = before[at - 1] == before[at] - 1
    share = np.zeros(n, np.int64)
    start = np.flatnonzero(~follows & (before >= 0))
    a, b, size = start, before[start], np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    word = np.lib.stride_tricks.as_strided(np.append(s, np.zeros(8, np.uint8)), (n, 8), (1, 1))
    long = np.ascontiguousarray(word).view("<u8").ravel()
    while len(live):
        x, y = a[live] + size[live], b[live] + size[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        differ = long[x] ^ long[y]
        equal = differ == 0
        low = differ & (~differ + np.uint64(1))
        size[live[~equal]] += np.log2(low[~equal].astype(np.float64)).astype(np.int64) // 8
        size[live[equal]] += 8
        live = live[equal]
    share[start] = np.minimum(size, n - np.maximum(a, b))
    last = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    share = share[last] - (np.arange(n) - last)
    return before, np.maximum(share, 0)


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text the starts of its substrings of ``length`` bytes that also start anywhere else in ``texts``."""
    s, starts = join_texts(texts)
    sa = suffix_array(s, length)
    before, share = common_prefixes(s, sa)
    found = np.zeros(len(s), bool)
    at = np.flatnonzero(share >= length)
    found[at] = True
    found[before[at]] = True
    # a text's last starts cannot hold a match: it would run over the end mark
    out = []
    for start, text in zip(starts.tolist(), texts):
        out.append(np.flatnonzero(found[start : start + max(0, len(text) - length + 1)]))
    return out
