"""Simple forecasts per series that models are measured against."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators import groups
from seriesloom.operators.boosting import boosted_series
from seriesloom.operators.groups import appended
from seriesloom.panel import names, trailing


def ma_baseline(df: DataFrame, group_cols: str | Sequence[str], date_col: str, signal_cols: Sequence[str], window_sizes: int | Sequence[int] = 13) -> DataFrame:
    """``baseline_<s>_ma_<w>``: trailing mean on train rows; on test rows the series' last one that is not NULL."""
    keys = names(group_cols)
    train = F.col("sample") == "train"
    windows = [window_sizes] if isinstance(window_sizes, int) else list(window_sizes)
    means, last = {}, {}
    for s in names(signal_cols):
        for w in windows:
            means[f"_ma_{s}_{w}"] = F.avg(s).over(trailing([*keys, "sample"], date_col, w))
            c = F.col(f"_ma_{s}_{w}")
            final = F.max_by(c, F.when(train & c.isNotNull(), F.col(date_col))).over(W.partitionBy(*keys))
            last[f"baseline_{s}_ma_{w}"] = F.when(train, c).otherwise(final)
    return df.withColumns(means).withColumns(last).drop(*means)


def croston_baseline(df: DataFrame, group_cols: str | Sequence[str], date_col: str, signal_cols: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """``baseline_<s>_croston``: level over interval, smoothed at each positive value; test rows get the last one, 0 without train rows.

    The recursion has no form that SQL could window, and a fold that gathers its results
    copies them at each step; so the series of a task step through their train rows
    together, in time that grows with the rows.
    """
    keys, signals = names(group_cols), names(signal_cols)
    number = lambda s: F.nanvl(F.col(s).cast("double"), F.lit(0.0))
    needed = {"train": is_train().cast("int")} | {s: F.coalesce(number(s), F.lit(0.0)) for s in signals}

    def compute(rows: dict[str, np.ndarray], series: np.ndarray) -> dict[str, np.ndarray]:
        made, train = {}, np.flatnonzero(rows["train"])
        for s in signals:
            value, final = np.zeros(len(series)), np.zeros(series[-1] + 1)
            value[train], own = croston(rows[s][train], series[train], alpha)
            final[own[0]] = own[1]
            made[f"baseline_{s}_croston"] = np.where(rows["train"] == 1, value, final[series])
        return made

    return appended(df, keys, [date_col], needed, [T.StructField(f"baseline_{s}_croston", T.DoubleType()) for s in signals], compute)


def is_train() -> Column:
    return F.coalesce(F.col("sample") == "train", F.lit(False))


def croston(y: np.ndarray, series: np.ndarray, alpha: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Forecast after each value, and (series, last forecast); values of a series stand together, in order."""
    out = np.zeros(len(y))
    if not len(y):
        return out, (series, out)
    first = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
    sizes = np.diff(np.r_[first, len(y)])
    level, between, waited = np.where(y[first] > 0, y[first], 0.0), np.ones(len(first)), np.ones(len(first))
    by_size = np.argsort(-sizes, kind="stable")
    first, level, between, waited, lasting = first[by_size], level[by_size], between[by_size], waited[by_size], sizes[by_size]
    for t in range(1, int(sizes.max())):
        live = int(np.searchsorted(-lasting, -t, "left"))  # series with more than t values come first
        now = y[first[:live] + t]
        hit = now > 0
        level[:live] += np.where(hit, alpha * (now - level[:live]), 0.0)
        between[:live] += np.where(hit, alpha * (waited[:live] - between[:live]), 0.0)
        waited[:live] = np.where(hit, 1.0, waited[:live] + 1.0)
        out[first[:live] + t] = level[:live] / np.maximum(between[:live], 1e-6)
    return out, (series[first], out[first + lasting - 1])


def lr_baseline(df: DataFrame, group_cols: str | Sequence[str], date_col: str, signal_cols: Sequence[str], feature_cols: Sequence[str]) -> DataFrame:
    """``baseline_<s>_lr``: per series least squares with intercept on train rows (missing y as 0); train rows keep the actual.

    One feature stays in SQL aggregates; several are solved for all series of a task together.
    Series with fewer than two train rows get NULL on test rows.
    """
    keys, out = names(group_cols), df
    for s in names(signal_cols):
        name = f"baseline_{s}_lr"
        y = F.coalesce(F.col(s).cast("double"), F.lit(0.0))
        train = F.col("sample") == "train"
        if len(feature_cols) == 1:
            x = F.col(feature_cols[0]).cast("double")
            # an intercept alone where x does not vary
            fits = out.where(train).groupBy(*keys).agg(
                F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("_b"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("_a"), F.count("*").alias("_n")
            )
            predicted = F.when(F.col("_n") > 1, F.col("_a") + F.col("_b") * x)
            out = out.join(fits, keys, "left").withColumn(name, F.when(train, F.col(s)).otherwise(predicted)).drop("_a", "_b", "_n")
            continue
        columns = list(feature_cols)
        needed = {"train": is_train().cast("int"), "y": y} | {f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
        out = appended(out, keys, [], needed, [T.StructField("_lr", T.DoubleType())], _lines(columns))
        out = out.withColumn(name, F.when(train, F.col(s)).otherwise(F.col("_lr"))).drop("_lr")
    return out


def _lines(columns: Sequence[str]):
    def compute(rows: dict[str, np.ndarray], series: np.ndarray) -> dict[str, np.ndarray]:
        x, own = np.column_stack([np.ones(len(series)), *[rows[f"x_{c}"] for c in columns]]), rows["train"] == 1
        return {"_lr": (x * least_squares(x[own], rows["y"][own], series[own], series[-1] + 1)[series]).sum(1)}

    return compute


def least_squares(x: np.ndarray, y: np.ndarray, series: np.ndarray, n: int) -> np.ndarray:
    """Coefficients of series 0..n-1 as ``np.linalg.lstsq`` gives them one by one; NaN for fewer than two rows.

    Rows of a series stand together. Series of about the same length are solved at once;
    rows of zeros, which no fit sees, make them equally long.
    """
    out, sizes = np.full((n, x.shape[1]), np.nan), np.bincount(series, minlength=n)
    place, level = np.arange(len(y)) - (np.cumsum(sizes) - sizes)[series], np.ceil(np.log2(np.maximum(sizes, 1)))
    for k in np.unique(level[sizes > 1]):
        own = np.flatnonzero((sizes > 1) & (level == k))
        at = np.full(n, -1)
        at[own] = np.arange(len(own))
        rows = np.flatnonzero(at[series] >= 0)
        a, b = np.zeros((len(own), max(sizes[own].max(), x.shape[1]), x.shape[1])), np.zeros((len(own), max(sizes[own].max(), x.shape[1]), 1))
        a[at[series[rows]], place[rows]] = x[rows]
        b[at[series[rows]], place[rows], 0] = y[rows]
        u, w, v = np.linalg.svd(a, full_matrices=False)
        least = np.finfo(float).eps * np.maximum(sizes[own], x.shape[1])[:, None] * w[:, :1]
        part = (u.transpose(0, 2, 1) @ b)[:, :, 0] * np.where(w > least, 1 / np.where(w > least, w, 1), 0)
        out[own] = (v.transpose(0, 2, 1) @ part[:, :, None])[:, :, 0]
    return out


def boosted_baseline(
    df: DataFrame, group_cols: str | Sequence[str], date_col: str, signal_cols: Sequence[str], feature_cols: Sequence[str], trees: int = 1000, rate: float = 0.05, leaves: int = 31
) -> DataFrame:
    """``baseline_<s>_lgbm``: boosted trees per series and cutoff on its train rows (missing y as 0), at least 0; train rows keep the actual.

    Series with fewer than two train rows get NULL on test rows. A missing feature counts
    as the smallest value. Series are dealt to tasks by their keys; a task grows the
    trees of all its series together, about four times ``groups.TOGETHER`` rows at a time.
    """
    keys, signals, columns = names(group_cols), names(signal_cols), list(feature_cols)
    keys += ["cutoff"] if "cutoff" in df.columns and "cutoff" not in keys else []
    needed = {"train": is_train().cast("int")} | {f"y_{s}": F.col(s).cast("double") for s in signals} | {f"x_{c}": F.col(c).cast("double") for c in columns}

    def compute(rows: dict[str, np.ndarray], series: np.ndarray) -> dict[str, np.ndarray]:
        train = rows["train"] == 1
        fits = np.bincount(series[train], minlength=series[-1] + 1) > 1
        place = np.cumsum(fits) - 1
        own, asked = train & fits[series], ~train & fits[series]
        x = np.nan_to_num(np.column_stack([rows[f"x_{c}"] for c in columns]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        made = {}
        for s in signals:
            y = rows[f"y_{s}"]
            value = np.where(train, y, np.nan)
            if asked.any():
                found = boosted_series(x[own], np.nan_to_num(y[own]), place[series[own]], x[asked], place[series[asked]], int(fits.sum()), trees, rate, leaves)
                value[asked] = np.maximum(found, 0.0)
            made[f"baseline_{s}_lgbm"] = value
        return made

    spark = df.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return appended(df, keys, [], needed, [T.StructField(f"baseline_{s}_lgbm", T.DoubleType()) for s in signals], compute, groups.TOGETHER * 4, tasks)


def run_baselines(
    df: DataFrame, group_cols: str | Sequence[str], date_col: str, signal_cols: Sequence[str], baseline_types: Sequence[str] = ("MA", "CROSTON"),
    window_sizes: int | Sequence[int] = 13, feature_cols: Sequence[str] | None = None, create_features: bool = False,
) -> DataFrame:
    """The named baselines one after the other; LR and ML need features. ``create_features`` adds a ``feature_`` twin of each."""
    out, before = df, set(df.columns)
    for kind in baseline_types:
        if kind in ("LR", "ML") and not feature_cols:
            raise ValueError(f"baseline {kind} needs feature_cols")
        if kind == "MA":
            out = ma_baseline(out, group_cols, date_col, signal_cols, window_sizes)
        elif kind == "CROSTON":
            out = croston_baseline(out, group_cols, date_col, signal_cols)
        elif kind == "LR":
            out = lr_baseline(out, group_cols, date_col, signal_cols, feature_cols)
        elif kind == "ML":
            out = boosted_baseline(out, group_cols, date_col, signal_cols, feature_cols)
        else:
            raise ValueError(f"unknown baseline: {kind}")
    if create_features:
        out = out.withColumns({f"feature_{c}": F.col(c) for c in out.columns if c not in before and c.startswith("baseline_")})
    return out
