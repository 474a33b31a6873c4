"""Least-squares boosted trees of many short series at once, in arrays over all of them."""

from __future__ import annotations

import heapq

import numpy as np

#: Values of a feature that can be told apart; more are joined by rank.
BINS = 255


def bin_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper edges of the bins of one feature: each value by itself, or as many ranks where there are more values."""
    edges = np.unique(values)
    if len(edges) > bins:
        edges = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:], method="inverted_cdf"))
    return edges


def _binned(x: np.ndarray, series: np.ndarray, ask: np.ndarray, ask_series: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    codes, ask_codes = np.zeros(x.T.shape, np.int64), np.zeros(ask.T.shape, np.int64)
    for s in range(n):
        own, asked = np.flatnonzero(series == s), np.flatnonzero(ask_series == s)
        for f in range(x.shape[1]):
            edges = bin_edges(x[own, f])
            codes[f, own] = np.searchsorted(edges[:-1], x[own, f])
            ask_codes[f, asked] = np.searchsorted(edges[:-1], ask[asked, f])
    return codes, ask_codes


def may_grow(series: np.ndarray, path: np.ndarray, most: int) -> np.ndarray:
    """Which splits can be among the ``most`` that a series takes: those whose path is no worse than the last of these."""
    order = np.lexsort((-path, series))
    own = series[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    sizes = np.diff(np.r_[first, len(own)])
    worst = path[order][first + np.minimum(sizes, most) - 1]
    out = np.empty(len(series), bool)
    out[order] = path[order] >= np.repeat(worst, sizes)
    return out


def best_first(gid: np.ndarray, parent: np.ndarray, series: np.ndarray, gain: np.ndarray, most: int) -> np.ndarray:
    """The splits a series takes: all if there are ``most`` or fewer, else one after the other, always the largest gain in reach."""
    few = np.bincount(series) <= most
    chosen = [gid[few[series]]]
    for s in np.unique(series[~few[series]]):
        below: dict[int, list[tuple[float, int]]] = {}
        for g, p, x in zip(*(v[series == s].tolist() for v in (gid, parent, gain))):
            below.setdefault(p, []).append((-x, g))
        reach, taken = below[-1], []
        while reach and len(taken) < most:
            taken.append(heapq.heappop(reach)[1])
            for x in below.get(taken[-1], ()):
                heapq.heappush(reach, x)
        chosen.append(np.array(taken, np.int64))
    return np.concatenate(chosen)


def _padded(values: np.ndarray, series: np.ndarray, n: int, fill: float) -> tuple[np.ndarray, np.ndarray]:
    """A row per series 0..n-1 of the values that are its own, and each value's flat place; shorter rows end in ``fill``."""
    order = np.argsort(series, kind="stable")
    sizes = np.bincount(series, minlength=n)
    place = np.empty(len(series), np.int64)
    place[order] = np.arange(len(series)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((n, int(sizes.max(initial=0))), fill, values.dtype)
    flat = series * out.shape[1] + place
    out.ravel()[flat] = values
    return out, flat


def _short_series(codes: np.ndarray, y: np.ndarray, series: np.ndarray, ask_codes: np.ndarray, ask_series: np.ndarray, n: int, trees: int, rate: float, least: int) -> np.ndarray:
    """``boosted_series`` for series so short that a tree takes every split with a gain, whatever the order.

    Each series is a row of a table, and so is each node, with zeros where rows are not
    its own. Rows stay in each feature's order, found once, so that a node's sums are
    running sums; the first node's counts are the same in every tree.
    """
    mean = np.bincount(series, y, n) / np.bincount(series, minlength=n)
    rest, _ = _padded(y - mean[series], series, n, 0.0)
    width, kinds, far = rest.shape[1], len(codes), int(codes.max(initial=0)) + 1
    code = np.stack([_padded(c, series, n, far)[0] for c in codes])
    padded_ask = [_padded(c, ask_series, n, 0) for c in ask_codes]
    ask_code, ask_flat = np.stack([p[0] for p in padded_ask]), padded_ask[0][1]
    there = code[0] < far
    rank = np.argsort(code, axis=2, kind="stable")  # rows in each feature's order, padding last
    ranked = np.take_along_axis(code, rank, 2)
    ends = np.ones(ranked.shape, bool)
    ends[..., :-1] = ranked[..., 1:] != ranked[..., :-1]
    ends &= ranked < far
    ends, ranked, rank = (np.ascontiguousarray(v.transpose(1, 0, 2)).reshape(n, kinds * width) for v in (ends, ranked, rank))
    own_leaf, ask_leaf_0 = (np.repeat(np.arange(n), k).reshape(n, k) for k in (width, ask_code.shape[2]))
    out, every = np.zeros(ask_code.shape[1:]), there.all()
    flat_code, flat_ask = code.reshape(kinds, -1), ask_code.reshape(kinds, -1)

    def counted(owner: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where a node's rows lie in each order, how many are left and right of each place, and which places may split it."""
        pick = rank[owner] + np.arange(0, len(owner) * width, width)[:, None]
        left = mine.ravel().take(pick).reshape(len(owner), kinds, width).cumsum(2, np.float64).reshape(len(owner), -1)
        right = left[:, -1:] - left
        ok = ends[owner] & (left >= least) & (right >= least)
        return pick, np.where(ok, left, 1.0), np.where(ok, right, 1.0), ok, left[:, -1]

    live, first = np.flatnonzero(there.sum(1) >= 2 * least), None
    for _ in range(trees):
        if not len(live):
            break
        if first is None:
            first = counted(live, there[live])
        leaf, ask_leaf, made, nodes, owner = own_leaf.copy(), ask_leaf_0.copy(), n, live, live
        pick, left, right, ok, m = first
        held, split_any = rest if len(live) == n else rest[live], np.zeros(n, bool)
        while True:
            part = held.ravel().take(pick).reshape(len(nodes), kinds, width).cumsum(2).reshape(len(nodes), -1)
            total = part[:, -1].copy()
            gain = total[:, None] - part
            gain *= gain
            gain /= right
            part *= part
            part /= left
            gain += part
            gain = np.where(ok, gain, -1.0)
            best = gain.argmax(1)
            split = np.flatnonzero(gain[np.arange(len(nodes)), best] - total**2 / m > 1e-12)
            if not len(split):
                break
            nodes, owner, best = nodes[split], owner[split], best[split]
            split_any[owner] = True
            child, feature, edge = np.full(made, -1), np.zeros(made, np.int64), np.zeros(made, np.int64)
            child[nodes], feature[nodes], edge[nodes] = made + 2 * np.arange(len(nodes)), best // width, ranked[owner, best]
            for place, table in ((leaf, flat_code), (ask_leaf, flat_ask)):
                flat = place.ravel()
                to = child.take(flat)
                go = np.flatnonzero(to >= 0)
                was = flat[go]
                flat[go] = to[go] + (table[feature[was], go] > edge[was])
            nodes, owner = made + np.arange(2 * len(nodes)), np.repeat(owner, 2)
            made += 2 * len(split)
            mine = leaf[owner] == nodes[:, None]
            if not every:
                mine &= there[owner]
            wide = np.count_nonzero(mine, axis=1) >= 2 * least
            if not wide.any():
                break
            nodes, owner, mine = nodes[wide], owner[wide], mine[wide]
            pick, left, right, ok, m = counted(owner, mine)
            held = rest[owner] * mine
        if not split_any[live].all():  # without a split nothing changes, in this tree or any later one
            live, first = live[split_any[live]], None
        inside = leaf.ravel() if every else np.where(there, leaf, made).ravel()
        sizes = np.bincount(inside, minlength=made + 1)
        step = rate * np.bincount(inside, rest.ravel(), made + 1) / np.maximum(sizes, 1)
        step[:n] = np.where(split_any, step[:n], 0.0)
        step[made] = 0.0
        rest -= step.take(inside).reshape(rest.shape)
        out += step.take(ask_leaf)
    return mean[ask_series] + out.ravel()[ask_flat]


def boosted_series(
    x: np.ndarray, y: np.ndarray, series: np.ndarray, ask: np.ndarray, ask_series: np.ndarray, n: int, trees: int, rate: float, leaves: int = 31, least: int = 20
) -> np.ndarray:
    """Values for the rows ``ask`` of series 0..n-1, each fitted on its own rows (x, y) alone; every series has one at least.

    Boosting starts from the mean; a tree grows its best leaf first, up to ``leaves``
    leaves of ``least`` rows each at least. All series grow level by level together. A
    split is taken no later than any whose path from the root holds a smaller gain, so
    that growth below the worst path of the ``leaves - 1`` best can stop. Series too short
    for more than ``leaves`` leaves take every split and go through ``_short_series``.
    """
    codes, ask_codes = _binned(x, series, ask, ask_series, n)
    sizes = np.bincount(series, minlength=n)
    short = sizes < (leaves + 1) * least  # leaves of ``least`` rows can't be more than ``leaves``
    if leaves > 1 and short.any() and len(codes) and len(ask):
        done = np.zeros(len(ask))
        for rows in np.unique(np.ceil(np.log2(sizes[short]))):  # of about the same length
            own = short & (np.ceil(np.log2(sizes)) == rows)
            place, a, b = np.cumsum(own) - 1, own[series], own[ask_series]
            if b.any():
                done[b] = _short_series(codes[:, a], y[a], place[series[a]], ask_codes[:, b], place[ask_series[b]], int(own.sum()), trees, rate, least)
        if not short.all():
            place, a, b = np.cumsum(~short) - 1, ~short[series], ~short[ask_series]
            done[b] = boosted_series(x[a], y[a], place[series[a]], ask[b], place[ask_series[b]], int((~short).sum()), trees, rate, leaves, least)
        return done
    width, kinds = int(codes.max(initial=0)) + 1, len(codes)
    mean = np.bincount(series, y, n) / np.bincount(series, minlength=n)
    rest, out = y - mean[series], mean[ask_series].copy()
    big = np.flatnonzero(np.bincount(series, minlength=n) >= 2 * least)
    start = np.flatnonzero(np.isin(series, big))
    if not len(start) or leaves < 2:
        return out
    ask_start = np.flatnonzero(np.isin(ask_series, big))
    for _ in range(trees):
        rows, asks = start, ask_start
        at, ask_at = np.searchsorted(big, series[rows]), np.searchsorted(big, ask_series[asks])
        gid, owner, path, above, made = big, big, np.full(len(big), np.inf), np.full(len(big), -1), n
        steps, found = [], [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        while len(rows):
            wide = np.bincount(at, minlength=len(gid)) >= 2 * least  # others cannot be split
            if not wide.all():
                place = np.cumsum(wide) - 1
                rows, at = rows[wide[at]], place[at[wide[at]]]
                asks, ask_at = asks[wide[ask_at]], place[ask_at[wide[ask_at]]]
                gid, owner, path, above = gid[wide], owner[wide], path[wide], above[wide]
                if not len(rows):
                    break
            cell = (at * (kinds * width) + np.arange(kinds)[:, None] * width + codes[:, rows]).ravel()
            shape = (len(gid), kinds, width)
            size = np.prod(shape)
            part = np.bincount(cell, np.broadcast_to(rest[rows], (kinds, len(rows))).ravel(), size).reshape(shape).cumsum(2)
            left = np.bincount(cell, minlength=size).reshape(shape).cumsum(2)
            total, m = part[:, :, -1:], left[:, :, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = part**2 / left + (total - part) ** 2 / (m - left) - total**2 / m
            gain = np.where((left >= least) & (m - left >= least), gain, -1.0).reshape(len(gid), -1)
            best = gain.argmax(1)
            gain = gain[np.arange(len(gid)), best]
            path = np.minimum(path, gain)
            split = np.flatnonzero(gain > 1e-12)
            if not len(split):
                break
            before = len(found[0])
            found = [np.concatenate(p) for p in zip(found, (gid[split], above[split], owner[split], gain[split], path[split]))]
            keep = split
            if len(found[0]) >= leaves:
                keep = split[may_grow(found[2], found[4], leaves - 1)[before:]]
            child = np.full(len(gid), -1)
            child[keep] = np.arange(len(keep)) * 2
            feature, edge = np.divmod(best, width)
            level = []
            for own, places, table in ((rows, at, codes), (asks, ask_at, ask_codes)):
                to = child[places]
                go = to >= 0
                own, places, to = own[go], places[go], to[go]
                to = to + (table[feature[places], own] > edge[places])
                level.append((own, gid[places], made + to, to))
            steps.append(level)
            (rows, _, _, at), (asks, _, _, ask_at) = level
            above, owner, path = (np.repeat(v[keep], 2) for v in (gid, owner, path))
            gid = made + np.arange(2 * len(keep))
            made += 2 * len(keep)
        if not len(found[0]):
            break  # nothing left to split, in this tree or any later one
        chosen = np.zeros(made, bool)
        chosen[best_first(*found[:4], leaves - 1)] = True
        leaf, ask_leaf = series.copy(), ask_series.copy()
        for level in steps:
            for place, (own, parent, to, _) in zip((leaf, ask_leaf), level):
                place[own[chosen[parent]]] = to[chosen[parent]]
        sizes = np.bincount(leaf, minlength=made)
        step = rate * np.bincount(leaf, rest, made) / np.maximum(sizes, 1)
        step[:n] = np.where(np.isin(np.arange(n), found[2]), step[:n], 0.0)
        rest -= step[leaf]
        out += step[ask_leaf]
    return out
