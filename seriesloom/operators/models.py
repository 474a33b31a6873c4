"""Regressors per cutoff and training group, their parameters, tuning and feature selection."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.checkpoints import materialize
from seriesloom.operators import fits, tuning
from seriesloom.operators.columns import sample_keys
from seriesloom.operators.groups import appended
from seriesloom.operators.guard import guardrail
from seriesloom.operators.pooled import fit_blocks
from seriesloom.operators.trees import Ensemble
from seriesloom.panel import clip0, finite_or_zero, names

MODELS = ("LGBM", "RF", "GBM", "ADA", "LR")
# The steps in ``heuristic_params`` are those that results must agree with.
#: Stands for a missing feature in trees: below every value, so that a split can send it aside.
ABSENT = -1e9
#: Rounds of AdaBoost between two checkpoints of the row weights.
CUT = 4


def heuristic_params(model: str, rows: int, features: int) -> dict[str, Any]:
    """Parameters from the number of training rows and features, in MLlib's names where it has them."""

    def step(x: int, limits: Sequence[float], values: Sequence) -> Any:
        return next((v for limit, v in zip(limits, values) if x < limit), values[len(limits)])

    if model == "LGBM":
        trees = step(rows, (1e3, 1e4, 1e5), (100, 500, 1000, 1500))
        rate = 0.1 if trees <= 100 else 0.05 if trees <= 500 else 0.01
        return {
            "maxIter": trees,
            "stepSize": rate,
            "maxDepth": step(features, (10, 50, 100), (5, 7, 9, 12)),
            "num_leaves": step(features, (10, 50), (32, 127, 127)),
            "minInstancesPerNode": step(rows, (1e3, 1e4, 1e5), (5, 10, 20, 50)),
            "featureSubsetStrategy": str(step(features, (10, 50, 100), (1.0, 0.9, 0.8, 0.7))),
            "subsamplingRate": step(rows, (1e3, 1e4, 1e5), (1.0, 0.9, 0.8, 0.7)),
            "reg_alpha": step(features, (20, 50, 100), (0.0, 0.01, 0.03, 0.05)),
            "reg_lambda": step(features, (20, 50, 100), (0.0, 0.01, 0.05, 0.1)),
        }
    if model == "RF":
        return {
            "numTrees": step(rows, (1e3, 1e4), (100, 200, 500)),
            "maxDepth": step(features, (10, 50), (10, 20, 30)),
            "minInstancesPerNode": step(rows, (1e3, 1e4), (1, 2, 4)),
        }
    if model == "GBM":
        trees, rate = step(rows, (1e3, 1e4), ((100, 0.1), (200, 0.05), (500, 0.02)))
        return {"maxIter": trees, "stepSize": rate, "maxDepth": step(features, (10, 50), (3, 4, 5))}
    if model == "ADA":
        trees, rate = step(rows, (1e3, 1e4), ((50, 1.0), (100, 0.5), (200, 0.3)))
        return {"maxIter": trees, "stepSize": rate}
    return {"regParam": 1e-6, "solver": "normal"}  # enough to solve collinear features in one step


def grid(model: str) -> dict[str, list]:
    """A search grid in MLlib's names where it has them."""
    trees = {"maxIter": [20, 50, 100], "stepSize": [0.02, 0.05, 0.1], "maxDepth": [3, 5, 7], "subsamplingRate": [0.7, 0.85, 1.0]}
    return {
        "LGBM": {
            "maxIter": [20, 50, 100], "stepSize": [0.02, 0.05, 0.1], "num_leaves": [15, 31, 64], "maxDepth": [4, 8, 12],
            "subsamplingRate": [0.6, 0.8, 1.0], "featureSubsetStrategy": ["0.6", "0.8", "1.0"], "reg_alpha": [0.0, 0.1, 0.5], "reg_lambda": [0.0, 0.1, 0.5],
        },
        "GBM": trees | {"minInstancesPerNode": [1, 5, 20]},
        "RF": {"numTrees": [20, 50, 100], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["onethird", "sqrt", "1.0"]},
        "ADA": {"maxIter": [10, 20, 50], "stepSize": [0.3, 0.5, 1.0]},
        "LR": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    }[model]


@dataclass
class Boosted:
    """AdaBoost.R2 of decision trees: a row's prediction is the weighted median of the trees'."""

    trees: list
    weights: list[float]
    features: str = "features"

    @property
    def featureImportances(self):  # noqa: N802
        total = sum(self.weights) or 1.0
        return sum(np.asarray(t.featureImportances.toArray()) * w for t, w in zip(self.trees, self.weights)) / total

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, t in enumerate(self.trees):
            out = t.copy({t.predictionCol: f"_p{i}"}).transform(out)
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(w).alias("w")) for i, w in enumerate(self.weights)]))
        half = sum(self.weights) / 2
        start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p"))
        median = F.aggregate(pairs, start, lambda s, x: F.struct((s.w + x.w).alias("w"), F.when(s.p.isNull() & (s.w + x.w >= half), x.p).otherwise(s.p).alias("p")), lambda s: s.p)
        return out.withColumn("prediction", median).drop(*[f"_p{i}" for i in range(len(self.trees))])


def fit_adaboost(train: DataFrame, label: str, params: dict, weight: str | None, seed: int) -> Boosted:
    """Each round fits a tree on the present row weights and turns them towards the rows it missed.

    Weights are written every CUT rounds, so that a round does not apply all trees before it again.
    """
    rounds, rate = params.get("maxIter", 50), params.get("stepSize", 1.0)
    rows = train.withColumn("_w", F.col(weight) if weight else F.lit(1.0))
    trees, weights = [], []
    for i in range(rounds):
        tree = DecisionTreeRegressor(featuresCol="features", labelCol=label, weightCol="_w", maxDepth=params.get("maxDepth", 3), seed=seed + i).fit(rows)
        scored = tree.transform(rows).withColumn("_e", F.abs(F.col("prediction") - F.col(label)))
        missed = scored.agg(F.max("_e").alias("worst"), F.sum(F.col("_w") * F.col("_e")).alias("e"), F.sum("_w").alias("w")).first()
        worst = missed.worst or 0.0
        if worst <= 0:
            return Boosted([*trees, tree], [*weights, 1.0])
        loss = missed.e / worst / missed.w
        if loss >= 0.5 and trees:
            break
        beta = max(loss, 1e-9) / max(1 - loss, 1e-9)
        trees.append(tree)
        weights.append(rate * math.log(1 / beta) if beta < 1 else 1e-3)
        turned = F.col("_w") * F.pow(F.lit(beta), rate * (1 - F.col("_e") / worst))
        rows = scored.withColumn("_w", turned).select(*rows.columns)
        if i % CUT == CUT - 1:
            rows = materialize(rows)
    return Boosted(trees, weights)


def estimator(model: str, label: str, params: dict, weight: str | None = None, seed: int = 42):
    shared = {"featuresCol": "features", "labelCol": label} | ({"weightCol": weight} if weight else {})
    if model in ("LGBM", "GBM"):
        return GBTRegressor(seed=seed, **shared, **{k: v for k, v in params.items() if k not in ("num_leaves", "reg_alpha", "reg_lambda")})
    if model == "RF":
        return RandomForestRegressor(seed=seed, **shared, **params)
    if model == "LR":
        return LinearRegression(**shared, **params)
    raise ValueError(f"unknown model: {model}")


def imputed(df: DataFrame, features: Sequence[str], model: str) -> tuple[DataFrame, list[str]]:
    """Missing features: far below all values for trees; for LR the median of the train rows (to a ten-thousandth of their ranks) plus a flag, without features that never vary."""
    if model != "LR":
        return df.withColumns({f"_x_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(ABSENT)), F.lit(ABSENT)) for c in features}), [f"_x_{c}" for c in features]
    train = df.where(F.col("sample") == "train")
    aggs = []
    for c in features:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None))
        aggs += [F.percentile_approx(x, 0.5, 10_000).alias(f"mid_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}"), F.count_if(x.isNull()).alias(f"na_{c}")]
    row = train.agg(*aggs).first()
    varied = [c for c in features if row[f"min_{c}"] != row[f"max_{c}"]] or list(features[:1])
    out = {f"_x_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(row[f"mid_{c}"] or 0.0))) for c in varied}
    flags = {f"_na_{c}": F.col(c).isNull().cast("double") for c in varied if row[f"na_{c}"]}
    return df.withColumns(out | flags), [*out, *flags]


@dataclass
class Fitted:
    frame: DataFrame
    model: Any = None
    params: dict = field(default_factory=dict)
    importances: list[tuple[str, float]] = field(default_factory=list)


#: Rows of a group, train and test, that one task fits; larger groups are fitted over all executors.
MOST_ROWS = {"RF": 20_000}
MOST = 100_000


def fits_one_task(model: str, rows: int) -> bool:
    return rows <= MOST_ROWS.get(model, MOST)


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("sample") == "train")


def _target(target: str) -> Column:
    return F.coalesce(F.nanvl(F.col(target).cast("double"), F.lit(0.0)), F.lit(0.0))


def _weight(use_weights: bool) -> Column:
    return F.coalesce(F.col("train_weight").cast("double"), F.lit(0.0)) if use_weights else F.lit(1.0)


def fit_groups(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, model: str, params: dict[str, dict] | dict | None = None, use_weights: bool = False, seed: int = 42,
    chosen: dict[str, Sequence[str]] | None = None, name: Column | None = None,
) -> DataFrame:
    """``df`` with ``prediction`` (at least 0) and ``_fit``: one model per group of equal ``keys``, all groups in one job.

    Each group is fitted inside one task on its train rows (missing target as 0), so it
    has to be one that ``fits_one_task``. Without ``params`` a group takes those of
    ``heuristic_params`` for its size. ``name`` (text) tells groups apart in ``chosen``,
    each group's own features, and, if ``params`` holds a dict per name, its own
    parameters. ``_fit`` has a model's parameters and importances as JSON, on the group's
    first row.
    """
    features, own = list(features), bool(params) and all(isinstance(v, dict) for v in params.values())
    needed = {"train": F.coalesce(F.col("sample") == "train", F.lit(False)).cast("int"), "y": _target(target), "w": _weight(use_weights), "name": F.lit("") if name is None else name}
    needed |= {f"x{i}": F.col(c).cast("double") for i, c in enumerate(features)}

    def compute(rows: dict[str, np.ndarray], group: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        prediction, told = np.zeros(len(group)), [None] * len(group)
        for low, high in zip(edges, edges[1:]):
            called = rows["name"][low]
            used = list(range(len(features))) if chosen is None else [features.index(c) for c in chosen.get(called, features)]
            x = np.column_stack([rows[f"x{i}"][low:high] for i in used]) if used else np.zeros((high - low, 0))
            train = rows["train"][low:high] == 1
            p = params.get(called) if own else params
            p = heuristic_params(model, int(train.sum()), len(used)) if p is None else p
            fitted = fits.fit(model, x[train], rows["y"][low:high][train], rows["w"][low:high][train], p, seed)
            prediction[low:high] = np.maximum(np.nan_to_num(fitted.predict(x), nan=0.0, posinf=0.0, neginf=0.0), 0.0)
            told[low] = json.dumps({"params": p, "importances": list(zip([features[i] for i in used], np.asarray(fitted.importances, float).tolist()))})
        return {"prediction": prediction, "_fit": pa.array(told, pa.string())}

    return appended(df, keys, ["sample"], needed, [T.StructField("prediction", T.DoubleType()), T.StructField("_fit", T.StringType())], compute, together=1)


def _told(text: str) -> tuple[dict, list[tuple[str, float]]]:
    fit = json.loads(text)
    return fit["params"], sorted(((n, v) for n, v in fit["importances"]), key=lambda x: -x[1])


def fit_predict(
    df: DataFrame, features: Sequence[str], target: str, model: str = "LGBM", params: dict | None = None, use_weights: bool = False, seed: int = 42, tune: bool = False, search: str = "halving",
    date_col: str | None = None, most: int | None = None, scoring: str = "neg_mean_squared_log_error", param_distributions: dict[str, Sequence] | None = None,
) -> Fitted:
    """Fits on train rows (missing target as 0) and predicts all rows, at least 0. What follows ``search`` is for tuning.

    Rows that fit one task are fitted there, others over all executors.
    """
    sizes = df.agg(F.count("*").alias("n"), F.count_if(F.col("sample") == "train").alias("train")).first()
    if tune and (search == "halving" or fits_one_task(model, sizes.train)):
        rows = tuning.rows_for(_train(df), F.lit(""), features, _target(target), _weight(use_weights), date_col, seed)
        found = tuning.search(rows, {"": sizes.train} if sizes.train else {}, model, param_distributions or grid(model), search, most, seed=seed, scoring=scoring)
        params, tune = tuning.pick(found, "", heuristic_params(model, sizes.train, len(features))), False
    if not tune and fits_one_task(model, sizes.n):
        one = materialize(fit_groups(df.withColumn("_one", F.lit(1)), ["_one"], features, target, model, params, use_weights, seed))
        told = one.where("_fit IS NOT NULL").select("_fit").first()
        params, importances = _told(told[0]) if told else (params or {}, [])
        return Fitted(one.select(*df.columns, "prediction"), None, params, importances)
    return fit_large(df, features, target, model, params, use_weights, seed, tune, search, date_col, most, scoring, param_distributions, sizes.train)


def fit_large(
    df: DataFrame, features: Sequence[str], target: str, model: str, params: dict | None, use_weights: bool, seed: int, tune: bool, search: str, date_col: str | None, most: int | None,
    scoring: str, param_distributions: dict[str, Sequence] | None, train_rows: int,
) -> Fitted:
    """One model over all executors: boosted trees by summed histograms, the others and grid or random tuning by MLlib."""
    if params is None:
        params = heuristic_params(model, train_rows, len(features))
    if tune or model not in ("LGBM", "GBM"):
        rows, inputs = imputed(df, features, model)
        rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).withColumn("_y", _target(target))
        weight = "_weight" if use_weights else None
        rows = rows.withColumn("_weight", _weight(use_weights)) if use_weights else rows
        train = _train(rows)
    if tune:
        params = tune_parameters(train, model, weight, search=search, most=most, seed=seed, date_col=date_col, scoring=scoring, param_distributions=param_distributions)
    if model in ("LGBM", "GBM"):
        x = F.array(*[F.col(c).cast("double") for c in features])
        ensemble = fit_blocks(_train(df).select(x.alias("x"), _target(target).alias("y"), _weight(use_weights).alias("w")), len(features), fits.growth_of(model, params, len(features), seed))
        ensemble.by_gain = model == "GBM"
        return Fitted(predicted(df, list(features), ensemble), ensemble, params, sorted(zip(features, ensemble.importances.tolist()), key=lambda v: -v[1]))
    if model == "ADA":
        fitted = fit_adaboost(train.select("features", "_y", *([weight] if weight else [])), "_y", params, weight, seed)
    else:
        fitted = Pipeline(stages=[estimator(model, "_y", params, weight, seed)]).fit(train)
    out = fitted.transform(rows)
    out = out.withColumn("prediction", clip0(finite_or_zero(F.col("prediction")))).select(*df.columns, "prediction")
    last = fitted.stages[-1] if isinstance(fitted, PipelineModel) else fitted
    scores = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    scores = np.abs(np.asarray(scores.toArray() if hasattr(scores, "toArray") else scores))
    return Fitted(out, fitted, params, sorted(zip([c.removeprefix("_x_") for c in inputs], scores.tolist()), key=lambda x: -x[1]))


def predicted(df: DataFrame, features: Sequence[str], ensemble: Ensemble) -> DataFrame:
    """``df`` with the ensemble's ``prediction``, at least 0; its own columns pass through as they are."""
    width = len(df.columns)
    rows = df.select("*", F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(width).field(i).to_numpy(zero_copy_only=False) for i in range(len(features))])
            values = np.maximum(np.nan_to_num(ensemble.predict(x.astype(float))), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(values)], [*b.schema.names[:width], "prediction"])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())]))


def score_column(scoring: str, actual: Column, predicted: Column) -> Column:
    """An aggregate that is larger for better predictions, under its usual name; predictions are at least 0 where logarithms are taken."""
    e = predicted - actual
    if scoring == "neg_mean_squared_log_error":
        return -F.avg(F.pow(F.log1p(F.greatest(predicted, F.lit(0.0))) - F.log1p(F.greatest(actual, F.lit(0.0))), F.lit(2.0)))
    if scoring == "neg_mean_squared_error":
        return -F.avg(e * e)
    if scoring == "neg_root_mean_squared_error":
        return -F.sqrt(F.avg(e * e))
    if scoring == "neg_mean_absolute_error":
        return -F.avg(F.abs(e))
    if scoring == "neg_median_absolute_error":
        return -F.percentile_approx(F.abs(e), 0.5, 10_000)
    if scoring == "r2":
        return 1 - F.try_divide(F.avg(e * e), F.var_pop(actual))
    raise ValueError(f"unknown scoring: {scoring}")


def tune_parameters(
    train: DataFrame, model: str, weight: str | None = None, candidates: Sequence[dict] | None = None, search: str = "halving", folds: int = 4, most: int | None = None, seed: int = 42,
    date_col: str | None = None, scoring: str = "neg_root_mean_squared_error", param_distributions: dict[str, Sequence] | None = None,
) -> dict:
    """The best of the candidate parameters by ``scoring`` over expanding folds.

    Candidates are those given, or all combinations of ``param_distributions``, or of the model's own ``grid``.

    Folds follow the date where there is one, else a fixed hash: fold k trains on the
    first k parts and validates on part k+1. ``grid`` tries all, ``random`` draws
    ``most`` of them (30), ``halving`` draws ``most`` (as many as 3,000 resources give
    2 rows a fold) and keeps the better third of them as the training share grows.
    """
    if candidates is None:
        table = param_distributions or grid(model)
        candidates = [dict(zip(table, v)) for v in itertools.product(*table.values())]
    order = np.random.default_rng(seed).permutation(len(candidates))
    most = most or (30 if search == "random" else 3000 // (2 * folds))
    pool = list(candidates) if search == "grid" else [candidates[i] for i in order[:most]]
    key = F.unix_date(date_col).cast("double") if date_col else F.pmod(F.xxhash64("features", F.lit(seed)), F.lit(1 << 20)).cast("double")
    edges = train.agg(F.percentile(key, F.array(*[F.lit(i / (folds + 1)) for i in range(1, folds + 1)])).alias("e")).first().e
    part = sum((F.when(key > e, 1).otherwise(0) for e in edges), F.lit(0))
    parts = train.select("features", "_y", *([weight] if weight else []), part.alias("_part")).persist()

    def error(p: dict, k: int) -> float:
        fit_on, check = parts.where(F.col("_part") < k), parts.where(F.col("_part") == k)
        fitted = fit_adaboost(fit_on.select("features", "_y"), "_y", p, None, seed) if model == "ADA" else estimator(model, "_y", p, weight, seed).fit(fit_on)
        score = fitted.transform(check).agg(score_column(scoring, F.col("_y"), F.col("prediction"))).first()[0]
        return float("inf") if score is None or math.isnan(score) else -score

    try:
        if search != "halving":
            return min(pool, key=lambda p: sum(error(p, k) for k in range(1, folds + 1)))
        for k in range(1, folds + 1):
            pool = sorted(pool, key=lambda p: error(p, k))[: max(1, math.ceil(len(pool) / 3))]
            if len(pool) == 1:
                break
        return pool[0]
    finally:
        parts.unpersist()


@dataclass
class Backtest:
    """All replicas with their predictions, and what was learned per (cutoff, training group)."""

    frame: DataFrame
    fitted: dict[tuple, Fitted]

    def feature_importance(self, top: int | None = None) -> list[dict]:
        """Mean, population deviation and count of each feature's importance over the models."""
        table: dict[str, list[float]] = {}
        for f in self.fitted.values():
            for name, score in f.importances:
                table.setdefault(name, []).append(score)
        rows = [{"feature": n, "mean": float(np.mean(v)), "std": float(np.std(v)), "count": len(v)} for n, v in table.items()]
        return sorted(rows, key=lambda r: (-r["mean"], r["feature"]))[:top]

    def best_hyperparams(self) -> dict[tuple, dict]:
        return {k: f.params for k, f in self.fitted.items()}


def run_backtesting(
    df: DataFrame, group_cols: str | Sequence[str], features: Sequence[str], target: str, training_group: str | None = None, model: str = "LGBM", params: dict | None = None,
    use_weights: bool = False, use_guardrail: bool = False, baseline_col: str | None = None, guardrail_limit: float = 2.5, best_features: bool | Sequence[str] = False,
    n_best_features: int = 15, tune_hyperparameters: bool = False, search_method: str = "halving", parallel: int = 2, seed: int = 42,
    date_col: str | None = None, n_candidates: int | None = None, scoring: str = "neg_mean_squared_log_error", param_distributions: dict[str, Sequence] | None = None,
) -> Backtest:
    """One model per cutoff and training group, then the guardrail.

    Groups that fit one task are all fitted in one job; larger ones each over all
    executors, ``parallel`` at a time. Tuning runs for all groups together (see
    ``tuning.search``; ``n_candidates`` is its ``most``), but for grid and random search
    of the larger ones; its folds follow ``date_col``, by default ``date`` where the
    frame has it. The driver holds a few numbers a group.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    if use_guardrail and not baseline_col:
        raise ValueError("a guardrail needs baseline_col")
    group = F.col(training_group).cast("int") if training_group else F.lit(1)
    frame = materialize(df.withColumn("training_group", group))
    date_col = date_col or ("date" if "date" in df.columns else None)
    keys = ["cutoff", "training_group"]
    text = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]
    name = F.concat(text[0], F.lit("|"), text[1])
    jobs = frame.groupBy(*keys).agg(F.first(name).alias("name"), F.count("*").alias("n"), F.count_if(F.col("sample") == "train").alias("train")).orderBy(*keys).collect()
    of = lambda j: frame.where(F.col("cutoff").eqNullSafe(F.lit(j.cutoff)) & F.col("training_group").eqNullSafe(F.lit(j.training_group)))
    chosen: dict[str, list[str]] = {j.name: list(features if best_features in (True, False) else best_features) for j in jobs}
    if best_features is True:
        chosen = {n: c[:n_best_features] for n, c in chosen.items()}  # where a sample is empty
        chosen |= best_by_group(_train(frame), keys, name, group_cols, features, target, n_best_features, seed=seed)
    known: dict[str, dict] = {} if params is None else {j.name: params for j in jobs}
    if tune_hyperparameters:
        sizes = {j.name: j.train for j in jobs if j.train and (search_method == "halving" or fits_one_task(model, j.train))}
        for used in {tuple(chosen[n]) for n in sizes}:  # groups of equal features search together
            same = {n: size for n, size in sizes.items() if tuple(chosen[n]) == used}
            rows = _train(frame) if len(same) == len(jobs) else _train(frame).where(name.isin(list(same)))
            rows = tuning.rows_for(rows, name, used, _target(target), _weight(use_weights), date_col, seed)
            known |= tuning.search(rows, same, model, param_distributions or grid(model), search_method, n_candidates, seed=seed, scoring=scoring).best
    small = [j for j in jobs if fits_one_task(model, j.n)]
    large = [j for j in jobs if not fits_one_task(model, j.n)]
    fitted: dict[tuple, Fitted] = {}
    frames = []
    if small:
        rows = frame if not large else frame.where(name.isin([j.name for j in small]))
        done = materialize(fit_groups(rows, keys, features, target, model, known or None, use_weights, seed, chosen, name))
        told = {tuple(r[:2]): _told(r[2]) for r in done.where("_fit IS NOT NULL").select(*keys, "_fit").collect()}
        frames.append(done.drop("_fit"))
        for j in small:
            own = F.col("cutoff").eqNullSafe(F.lit(j.cutoff)) & F.col("training_group").eqNullSafe(F.lit(j.training_group))
            fitted[j.cutoff, j.training_group] = Fitted(frames[0].where(own), None, *told[j.cutoff, j.training_group])

    def one(j: Any) -> Fitted:
        tune = tune_hyperparameters and j.name not in known
        return fit_large(of(j), chosen[j.name], target, model, known.get(j.name), use_weights, seed, tune, search_method, date_col, n_candidates, scoring, param_distributions, j.train)

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        for j, f in zip(large, pool.map(one, large)):
            fitted[j.cutoff, j.training_group] = f
            frames.append(f.frame)
    out = frames[0] if frames else frame.withColumn("prediction", F.lit(None).cast("double"))
    for f in frames[1:]:
        out = out.unionByName(f)
    if use_guardrail:
        test = guardrail(out.where(F.col("sample") == "test"), group_cols, baseline_col, guardrail_limit)
        out = out.where(F.col("sample") == "train").unionByName(test, allowMissingColumns=True)
    return Backtest(out, fitted)


def neighbour_radius(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Distance of each point to its k-th nearest other one, the larger of the two coordinates' distances counting.

    Points stand in the order of the coordinate with more different values. Around each
    the window of points grows to both sides, for all points together, and a point leaves
    as soon as the next ones there lie no nearer than the k-th found; so a point meets
    about as many others as lie in the strip of its radius.
    """
    if len(np.unique(x)) < len(np.unique(y)):
        x, y = y, x
    n, order = len(x), np.lexsort((y, x))
    x, y = x[order], y[order]
    best = np.full((n, k), np.inf)
    live = np.arange(n)
    for step in range(1, n):
        reach = np.full(len(live), np.inf)  # how near the next ones can be
        for at in (live - step, live + step):
            inside = (at >= 0) & (at < n)
            own, other = live[inside], at[inside]
            dx = np.abs(x[own] - x[other])
            reach[inside] = np.minimum(reach[inside], dx)
            d = np.maximum(dx, np.abs(y[own] - y[other]))
            near = d < best[own, -1]
            own = own[near]
            best[own, -1] = d[near]
            best[own] = np.sort(best[own], axis=1)
        live = live[reach < best[live, -1]]
        if not len(live):
            break
    out = np.empty(n)
    out[order] = best[:, -1]
    return out


def within(v: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many values, the own one too, lie nearer than ``radius``: by two searches among the different values."""
    values, sizes = np.unique(v, return_counts=True)
    below, n = np.r_[0, np.cumsum(sizes)], len(values)
    low, high = np.searchsorted(values, v - radius, "right"), np.searchsorted(values, v + radius, "left")
    near = lambda at: np.abs(v - values[np.clip(at, 0, n - 1)]) < radius
    # a difference may round to the other side of the radius than the sum did
    low = np.where((low > 0) & near(low - 1), low - 1, np.where((low < n) & ~near(low), low + 1, low))
    high = np.where((high < n) & near(high), high + 1, np.where((high > 0) & ~near(high - 1), high - 1, high))
    return np.where(radius > 0, below[high] - below[low], 0)


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate of the mutual information of two samples, at least 0 (Kraskov, Stoegbauer and Grassberger, 2004)."""
    n = len(x)
    k = min(k, n - 1)
    if n < 2 or k < 1:
        return 0.0
    scale = lambda v: (v - v.mean()) / (v.std() or 1.0)
    x, y = scale(x), scale(y)
    radius = neighbour_radius(x, y, k)
    nx, ny = within(x, radius), within(y, radius)
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])
    psi = lambda m: harmonic[np.maximum(m, 1) - 1] - 0.5772156649015329
    return max(0.0, float(psi(np.array([n]))[0] + psi(np.array([k]))[0] - (psi(nx) + psi(ny)).mean()))


def feature_scores(train: DataFrame, group_cols: str | Sequence[str], features: Sequence[str], target: str, share: float = 0.25, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, feature, score): mutual information with the target inside each sampled series, averaged over series.

    All rows of a series count. Series are sampled, and scores averaged, per ``by``, all in one job.
    """
    keys, by = names(group_cols), list(by)
    keys = [*by, *[k for k in keys if k not in by]]
    sampled = sample_keys(train, keys, share, seed, by)
    same = None
    for k in keys:  # keys may be null
        sampled = sampled.withColumnRenamed(k, f"_k_{k}")
        equal = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = equal if same is None else same & equal
    rows = train.join(sampled, same, "left_semi")
    columns = list(features)
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = rows.select(*keys, *[number(c).alias(f"_x{i}") for i, c in enumerate(columns)], number(target).alias("_y"))
    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("feature", T.StringType()), T.StructField("score", T.DoubleType())])

    def scores(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["_y"].to_numpy()
        own = {c: [pdf[c].iloc[0]] * len(columns) for c in by}
        return pd.DataFrame(own | {"feature": columns, "score": [mutual_information(pdf[f"_x{i}"].to_numpy(), y) for i in range(len(columns))]})

    each = rows.groupBy(*keys).applyInPandas(scores, schema)
    return each.groupBy(*by, "feature").agg(F.avg("score").alias("score"))


def best_by_group(
    train: DataFrame, by: Sequence[str], name: Column, group_cols: str | Sequence[str], features: Sequence[str], target: str, n: int = 15, share: float = 0.25, seed: int = 42
) -> dict[str, list[str]]:
    """The ``n`` best features of each group of equal ``by``, all in one job; groups whose sample is empty are not in it."""
    scores = feature_scores(train, group_cols, features, target, share, seed, by)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "feature"))
    out: dict[str, list[str]] = {}
    for r in scores.withColumn("rank", rank).where(F.col("rank") <= n).select(name.alias("name"), "feature").orderBy("name", "rank").collect():
        out.setdefault(r.name, []).append(r.feature)
    return out


def best_by_mutual_information(train: DataFrame, group_cols: str | Sequence[str], features: Sequence[str], target: str, n: int = 15, share: float = 0.25, seed: int = 42) -> list[str]:
    """The ``n`` best features; the first ``n`` where the sample is empty."""
    rows = feature_scores(train, group_cols, features, target, share, seed).orderBy(F.desc("score"), "feature").limit(n).collect()
    return [r.feature for r in rows] or list(features)[:n]
