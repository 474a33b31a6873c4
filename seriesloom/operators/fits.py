"""The regressors on arrays, for groups of rows that one task holds. Parameters have MLlib's names."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np

from seriesloom.operators.trees import Arrays, Ensemble, Growth, Tree, edges_of, encode, fit_arrays, grow, width_of

#: Rounds of coordinate descent at most, and the step that counts as none.
SWEEPS, STILL = 1000, 1e-10


class Regressor(Protocol):
    """What every fit gives."""

    importances: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray: ...


def share(strategy: Any, features: int) -> float:
    """The share of columns behind a ``featureSubsetStrategy``; all where none is given."""
    named = {"all": 1.0, "auto": 1 / 3, "onethird": 1 / 3, "sqrt": math.sqrt(features) / features, "log2": max(1.0, math.log2(features)) / features}
    given = named[strategy] if strategy in named else float(1.0 if strategy is None else strategy)
    return given if given <= 1 else given / features


def growth_of(model: str, params: dict, features: int, seed: int) -> Growth:
    """``num_leaves`` bounds the leaves of LGBM; the other ensembles grow to their depth."""
    depth = params.get("maxDepth", {"LGBM": 0, "RF": 5}.get(model, 3))
    return Growth(
        trees=params.get("numTrees", params.get("maxIter", 100)),
        rate=params.get("stepSize", 0.1),
        leaves=params.get("num_leaves", 31) if model == "LGBM" else 1 << depth,
        depth=depth,
        least=params.get("minInstancesPerNode", 20 if model == "LGBM" else 1),
        l1=params.get("reg_alpha", 0.0),
        l2=params.get("reg_lambda", 0.0),
        columns=share(params.get("featureSubsetStrategy"), features),
        rows=params.get("subsamplingRate", 1.0),
        seed=seed,
    )


@dataclass
class Adaptive:
    """AdaBoost.R2: a row's prediction is the weighted median of the trees'."""

    edges: list[np.ndarray]
    start: float
    trees: list[Tree]
    weights: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = encode(x, self.edges)
        each = np.array([t.value[t.leaf(codes)] for t in self.trees]) + self.start
        order = np.argsort(each, axis=0, kind="stable")
        reached = np.cumsum(np.array(self.weights)[order], axis=0)
        return np.take_along_axis(each, np.take_along_axis(order, (reached >= reached[-1] / 2).argmax(0)[None], 0), 0)[0]

    @property
    def importances(self) -> np.ndarray:
        return Ensemble(self.edges, 0.0, self.trees, True).importances


def _one_tree(codes: np.ndarray, rest: np.ndarray, weight: np.ndarray, growth: Growth, number: int, width: int) -> Tree:
    source, columns = Arrays(codes, rest, weight, growth, width), growth.sees(number, len(codes))
    return grow(lambda tree, level: source.best(number, tree, level, columns), growth, columns)


def fit_forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, growth: Growth) -> Ensemble:
    """The mean of trees on as many rows, drawn with repetition."""
    edges, mean, n = edges_of(x), float(np.average(y, weights=weight)), len(y)
    codes, out = encode(x, edges), Ensemble(edges, mean, by_gain=True)
    for number in range(growth.trees):
        drawn = np.bincount(np.random.default_rng([growth.seed, 1, number]).integers(0, n, n), minlength=n)
        tree = _one_tree(codes, y - mean, weight * drawn, growth, number, width_of(edges))
        tree.value /= growth.trees
        out.trees.append(tree)
    return out


def fit_adaptive(x: np.ndarray, y: np.ndarray, weight: np.ndarray, growth: Growth) -> Adaptive:
    """Each round fits a tree on the present row weights and turns them towards the rows it missed."""
    edges, mean = edges_of(x), float(np.average(y, weights=weight))
    codes, w, out = encode(x, edges), weight.astype(float), Adaptive(edges, mean, [], [])
    for number in range(growth.trees):
        tree = _one_tree(codes, y - mean, w, growth, number, width_of(edges))
        error = np.abs(mean + tree.value[tree.leaf(codes)] - y)
        worst = error[w > 0].max(initial=0.0)
        loss = float(np.average(error / worst, weights=w)) if worst > 0 else 0.0
        if worst <= 0:
            return Adaptive(edges, mean, [*out.trees, tree], [*out.weights, 1.0])
        if loss >= 0.5 and out.trees:
            break
        beta = max(loss, 1e-9) / max(1 - loss, 1e-9)
        out.trees.append(tree)
        out.weights.append(growth.rate * math.log(1 / beta) if beta < 1 else 1e-3)
        w = w * beta ** (growth.rate * (1 - error / worst))
        w = w / w.sum() * weight.sum()
    return out


@dataclass
class Line:
    """Least squares over features, with medians for missing values and a flag for features that had some."""

    varied: np.ndarray
    middle: np.ndarray
    flagged: np.ndarray
    intercept: float
    slopes: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.varied]
        return np.column_stack([np.where(np.isnan(x), self.middle, x), np.isnan(x[:, self.flagged]).astype(float)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + self.inputs(x) @ self.slopes

    importances: np.ndarray | None = None


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: dict) -> Line:
    """Weighted least squares; ``regParam`` and ``elasticNetParam`` pull the slopes of features of unit deviation towards 0."""
    there = ~np.isnan(x)
    low, high = (f(np.where(there, x, s), axis=0, initial=s) for f, s in ((np.min, np.inf), (np.max, -np.inf)))
    varied = np.flatnonzero(low < high)
    varied = varied if len(varied) else np.arange(min(1, x.shape[1]))
    middle = np.array([np.quantile(x[there[:, f], f], 0.5, method="inverted_cdf") if there[:, f].any() else 0.0 for f in varied])
    out = Line(varied, middle, np.flatnonzero(~there[:, varied].all(0)), 0.0, np.zeros(0))
    z, w = out.inputs(x), weight / weight.sum()
    center, mean = w @ z, float(w @ y)
    scale = np.sqrt(w @ (z - center) ** 2)
    scale[scale == 0] = 1.0
    u, v = (z - center) / scale, y - mean
    l1, l2 = params.get("regParam", 0.0) * params.get("elasticNetParam", 0.0), params.get("regParam", 0.0) * (1 - params.get("elasticNetParam", 0.0))
    spread = math.sqrt(float(w @ v**2)) or 1.0
    l2 /= spread  # as MLlib has it, which scales y too
    gram, towards = (u * w[:, None]).T @ u, (u * w[:, None]).T @ v
    if l1 == 0:
        b = np.linalg.lstsq(gram + l2 * np.eye(len(gram)), towards, rcond=None)[0]
    else:
        b = np.zeros(len(gram))
        for _ in range(SWEEPS):
            before = b.copy()
            for j in range(len(b)):
                r = towards[j] - gram[j] @ b + gram[j, j] * b[j]
                b[j] = np.sign(r) * max(abs(r) - l1, 0.0) / (gram[j, j] + l2) if gram[j, j] + l2 > 0 else 0.0
            if np.abs(b - before).max(initial=0.0) < STILL * spread:
                break
    out.slopes, out.importances = b / scale, np.zeros(x.shape[1])
    out.intercept = mean - float(center @ out.slopes)
    out.importances[varied] = np.abs(out.slopes[: len(varied)])
    return out


def fit(model: str, x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: dict, seed: int = 42) -> Regressor:
    """A regressor of the rows (x: NaN where missing); without a weighted row it says 0."""
    if not (weight > 0).any():
        return Ensemble([np.zeros(0)] * x.shape[1], 0.0)
    if model == "LR":
        return fit_line(x, y, weight, params)
    growth = growth_of(model, params, x.shape[1], seed)
    out = {"RF": fit_forest, "ADA": fit_adaptive}.get(model, fit_arrays)(x, y, weight, growth)
    if model == "GBM":
        out.by_gain = True
    return out


def score(scoring: str, actual: np.ndarray, predicted: np.ndarray) -> float:
    """Larger for better predictions; at least 0 where logarithms are taken."""
    e = predicted - actual
    if scoring == "neg_mean_squared_log_error":
        return -float(np.mean((np.log1p(np.maximum(predicted, 0)) - np.log1p(np.maximum(actual, 0))) ** 2))
    if scoring == "neg_mean_squared_error":
        return -float(np.mean(e**2))
    if scoring == "neg_root_mean_squared_error":
        return -float(np.sqrt(np.mean(e**2)))
    if scoring == "neg_mean_absolute_error":
        return -float(np.mean(np.abs(e)))
    if scoring == "neg_median_absolute_error":
        return -float(np.median(np.abs(e)))
    if scoring == "r2":
        return 1 - float(np.mean(e**2) / np.var(actual)) if np.var(actual) > 0 else -math.inf
    raise ValueError(f"unknown scoring: {scoring}")
