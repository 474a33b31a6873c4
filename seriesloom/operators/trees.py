"""Regression trees over binned features, grown leaf by leaf from histograms that may be summed anywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

from seriesloom.operators.boosting import best_first, bin_edges, may_grow

#: Cells of histograms, and cells of rows, that are added up at once.
CELLS, READ = 1 << 19, 1 << 22


@dataclass(frozen=True)
class Growth:
    """How trees grow: ``depth`` 0 sets no limit; ``columns`` and ``rows`` are the shares a tree sees."""

    trees: int = 100
    rate: float = 0.1
    leaves: int = 31
    depth: int = 0
    least: int = 20
    l1: float = 0.0
    l2: float = 0.0
    columns: float = 1.0
    rows: float = 1.0
    seed: int = 42

    def sees(self, tree: int, features: int) -> np.ndarray:
        """Features that a tree may split."""
        n = max(1, round(self.columns * features))
        return np.arange(features) if n >= features else np.sort(np.random.default_rng([self.seed, tree]).choice(features, n, replace=False))

    def draws(self, tree: int, block: int, n: int) -> np.ndarray | None:
        """Rows of a block that a tree sees, the same ones whenever it is asked; None for all."""
        return None if self.rows >= 1 else np.random.default_rng([self.seed, tree, block]).random(n) < self.rows


@dataclass
class Tree:
    """Node i sends bins up to ``edge`` to ``left``, missing values where ``missing_left`` says; ``feature`` is -1 at leaves."""

    feature: np.ndarray
    edge: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaf(self, codes: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, on from the nodes ``at`` if they are known; ``codes`` has a row per feature."""
        at = np.zeros(codes.shape[1], np.int64) if at is None else at.copy()
        rows = np.flatnonzero(self.feature[at] >= 0)
        while len(rows):
            node = at[rows]
            code = codes[self.feature[node], rows]
            at[rows] = np.where(np.where(code == 0, self.missing_left[node], code <= self.edge[node]), self.left[node], self.right[node])
            rows = rows[self.feature[at[rows]] >= 0]
        return at


@dataclass
class Ensemble:
    """``start`` plus the leaf values of all trees."""

    edges: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)
    by_gain: bool = False

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = encode(x, self.edges)
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += tree.value[tree.leaf(codes)]
        return out

    @property
    def importances(self) -> np.ndarray:
        """How often each feature is split, or its share of all gains."""
        out = np.zeros(len(self.edges))
        for tree in self.trees:
            splits = np.flatnonzero(tree.feature >= 0)
            np.add.at(out, tree.feature[splits], tree.gain[splits] if self.by_gain else 1.0)
        return out / (out.sum() or 1.0) if self.by_gain else out


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """Upper edges of each feature's bins, from its values that are not NaN."""
    return [bin_edges(c[~np.isnan(c)]) if (~np.isnan(c)).any() else np.zeros(0) for c in x.T]


def width_of(edges: Sequence[np.ndarray]) -> int:
    """Bins of a feature at most: 0 for a missing value, then 1 and more in the order of values."""
    return 1 + max([1, *map(len, edges)])


def encode(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins, a row per feature; what is above all edges goes to the last bin."""
    out = np.empty(x.T.shape, np.uint8)
    for f, e in enumerate(edges):
        out[f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(e[:-1], x[:, f]) + 1)
    return out


def histograms(codes: np.ndarray, place: np.ndarray, rest: np.ndarray, weight: np.ndarray, nodes: int, columns: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sums of weighted rests, weights and rows per (column, node, bin), some columns at a time; rows whose place is negative are left out."""
    rows = np.flatnonzero((place >= 0) & (weight > 0))
    w, base = weight[rows], place[rows] * width
    g = w * rest[rows]
    step = max(1, min(CELLS // (nodes * width), READ // max(1, len(rows))))
    for at in range(0, len(columns), step):
        some = columns[at : at + step]
        cell = (codes[some][:, rows] + base + np.arange(len(some))[:, None] * (nodes * width)).ravel()
        each = lambda v: np.broadcast_to(v, (len(some), len(rows))).ravel()  # noqa: B023, E731
        yield np.stack([np.bincount(cell, v, len(some) * nodes * width) for v in (each(g), each(w), None)], 1).reshape(len(some), nodes, width, 3)


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _score(sums: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return soft(sums[..., 0], l1) ** 2 / (sums[..., 1] + l2)


#: Per (column, node): gain, edge, whether missing values go left (1 or 0), then the sums of the left side and of the node.
BEST = 9


def best_splits(h: np.ndarray, growth: Growth) -> np.ndarray:
    """The best split of each (column, node) from its histogram; gain -1 where there is none.

    Missing values are tried on both sides; where a node has none they would go left,
    below all values.
    """
    shape, h = h.shape[:2], h.reshape(-1, *h.shape[2:])
    total = h.sum(1, keepdims=True)
    left = h[:, 1:].cumsum(1)[:, None]
    if h[:, 0, 2].any():
        left = np.concatenate([left + h[:, None, :1], left], 1)  # (node, side of missing values, edge, sum)
    right = total[:, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _score(left, growth.l1, growth.l2) + _score(right, growth.l1, growth.l2) - _score(total[:, None], growth.l1, growth.l2)
    least = max(growth.least, 1)
    allowed = (left[..., 2] >= least) & (right[..., 2] >= least) & ~np.isnan(gain)
    allowed[:, 1:] &= h[:, None, :1, 2] > 0
    gain = np.where(allowed, gain, -1.0).reshape(len(h), -1)
    best, node = gain.argmax(1), np.arange(len(h))
    side, edge = np.divmod(best, left.shape[2])
    return np.column_stack([gain[node, best], edge + 1, side == 0, left[node, side, edge], total[:, 0]]).reshape(*shape, BEST)


def grow(ask: Callable[[Tree, list[int]], np.ndarray], growth: Growth, columns: np.ndarray) -> Tree:
    """One tree, its best leaf first, up to ``leaves`` leaves.

    ``ask`` gets the tree so far and the nodes of a level, and answers with the best split
    of each (column, node), as ``best_splits`` has it. Growth goes level by level, below
    every split that the finished tree can still take.
    """
    feature, edge, missing, left, right, sums, depth, path = [-1], [0], [True], [-1], [-1], [np.zeros(3)], [0], [np.inf]
    parent, level = [-1], [0]
    found: list[tuple[int, int, float, float]] = []  # node, its parent, gain, smallest gain on its path

    def so_far() -> Tree:
        return Tree(*(np.array(v) for v in (feature, edge, missing, left, right)), *np.zeros((2, len(feature))))

    while level and growth.leaves > 1:
        best = ask(so_far(), level)
        gain = best[:, :, 0]
        choice = gain.argmax(0)
        split = []
        for i, node in enumerate(level):
            top = best[choice[i], i]
            sums[node] = top[6:9]
            if top[0] > 1e-12:
                path[node] = min(path[node], top[0])
                found.append((node, parent[node], top[0], path[node]))
                split.append((node, top, int(columns[choice[i]])))
        if len(found) >= growth.leaves and split:
            may = may_grow(np.zeros(len(found), np.int64), np.array([f[3] for f in found]), growth.leaves - 1)[-len(split) :]
            split = [s for s, m in zip(split, may) if m]
        level = []
        for node, top, f in split:
            feature[node], edge[node], missing[node] = f, int(top[1]), bool(top[2])
            left[node], right[node] = len(feature), len(feature) + 1
            for s in (top[3:6], top[6:9] - top[3:6]):
                if s[2] >= 2 * max(growth.least, 1) and (not growth.depth or depth[node] + 1 < growth.depth):  # else it cannot be split
                    level.append(len(feature))
                for table, v in ((feature, -1), (edge, 0), (missing, True), (left, -1), (right, -1), (sums, s), (depth, depth[node] + 1), (path, path[node]), (parent, node)):
                    table.append(v)
    taken, gains = np.zeros(len(feature), bool), np.zeros(len(feature))
    if found:
        node, above, gain, _ = (np.array(v) for v in zip(*found))
        gains[node] = gain
        taken[best_first(node, above, np.zeros(len(node), np.int64), gain, growth.leaves - 1)] = True
    tree = so_far()
    tree.feature, tree.gain = np.where(taken, tree.feature, -1), np.where(taken, gains, 0.0)
    total = np.array(sums)
    tree.value = np.divide(soft(total[:, 0], growth.l1), total[:, 1] + growth.l2, out=np.zeros(len(total)), where=total[:, 1] + growth.l2 > 0)
    return tree


class Source(Protocol):
    """Where the rows are: in arrays here, or in blocks of a Spark job."""

    features: int

    def best(self, number: int, tree: Tree, level: list[int], columns: np.ndarray) -> np.ndarray: ...

    def take(self, tree: Tree) -> None: ...


def boost(source: Source, growth: Growth, edges: list[np.ndarray], start: float) -> Ensemble:
    """Trees one after the other, each fitted to what the ones before it left over."""
    out = Ensemble(edges, start)
    for number in range(growth.trees):
        columns = growth.sees(number, source.features)
        tree = grow(lambda t, level: source.best(number, t, level, columns), growth, columns)
        if (tree.feature < 0).all():
            if growth.columns >= 1 and growth.rows >= 1:
                break  # nor would any later tree find a split
            continue
        tree.value *= growth.rate
        source.take(tree)
        out.trees.append(tree)
    return out


class Arrays:
    """Rows held here."""

    def __init__(self, codes: np.ndarray, rest: np.ndarray, weight: np.ndarray, growth: Growth, width: int) -> None:
        self.codes, self.rest, self.weight, self.growth, self.features, self.width = codes, rest.copy(), weight, growth, len(codes), width
        self.number, self.drawn, self.at = -1, weight, np.zeros(0, np.int64)

    def best(self, number: int, tree: Tree, level: list[int], columns: np.ndarray) -> np.ndarray:
        if self.number != number:
            sees = self.growth.draws(number, 0, len(self.rest))
            self.number, self.drawn, self.at = number, self.weight if sees is None else np.where(sees, self.weight, 0.0), np.zeros(len(self.rest), np.int64)
        self.at = tree.leaf(self.codes, self.at)
        each = histograms(self.codes, place_of(tree, level, self.at), self.rest, self.drawn, len(level), columns, self.width)
        return np.concatenate([best_splits(h, self.growth) for h in each])

    def take(self, tree: Tree) -> None:
        self.rest -= tree.value[tree.leaf(self.codes)]


def place_of(tree: Tree, level: Sequence[int], at: np.ndarray) -> np.ndarray:
    """Which node of the level a row is at, -1 for none."""
    where = np.full(len(tree.feature), -1)
    where[list(level)] = np.arange(len(level))
    return where[at]


def fit_arrays(x: np.ndarray, y: np.ndarray, weight: np.ndarray, growth: Growth) -> Ensemble:
    """A boosted ensemble of rows held here; NaN is a missing feature."""
    edges = edges_of(x)
    start = float(np.average(y, weights=weight)) if weight.sum() > 0 else 0.0
    return boost(Arrays(encode(x, edges), y - start, weight, growth, width_of(edges)), growth, edges, start)
