"""Encodings, calendar terms, windows, lags and the bundle that runs them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.functions.frequency import frequency_params
from seriesloom.functions.ranks import running_before
from seriesloom.operators import statistics
from seriesloom.panel import double_columns, names, ordered, string_columns, trailing, upto

#: Parts of signal names that are never windowed or lagged.
DERIVED = ("sin_", "cos_", "trend_", "seasonal_", "weeks_until")


def encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature_<c>``: 0-based place of the value among the sorted distinct values, NULL last.

    The distinct values are numbered by ranges and joined back.
    """
    out = df
    for c in names(columns):
        values = df.select(F.col(c).alias("_v")).distinct()
        places = running_before(values, [F.col("_v").asc_nulls_last()], {"_place": F.lit(1)})
        places = places.select("_v", F.col("_place").cast("int").alias(f"feature_{c}"))
        out = out.join(places, F.col(c).eqNullSafe(F.col("_v")), "left").drop("_v")
    return out


def periods(df: DataFrame, group_cols: str | Sequence[str], date_col: str, target: str) -> DataFrame:
    """``feature_periods``: rows since the series began, 0 until the first positive target; and two powers of it."""
    started = F.max(F.when(F.col(target) > 0, 1).otherwise(0)).over(upto(group_cols, date_col)) == 1
    count = F.when(started, F.row_number().over(ordered(group_cols, date_col))).otherwise(0).cast("double")
    out = df.withColumn("feature_periods", count)
    return out.withColumns({"feature_periods_expanding": F.pow("feature_periods", F.lit(1.10)), "feature_periods_sqrt": F.sqrt("feature_periods")})


def calendar_columns(date_col: str) -> dict[str, Column]:
    d = F.col(date_col)
    return {
        "feature_year": F.year(d),
        "feature_quarter": F.quarter(d),
        "feature_month": F.month(d),
        "feature_week": F.weekofyear(d),
        "feature_day": F.dayofmonth(d),
        "feature_dayofweek": F.weekday(d),
    }


def fourier_columns(date_col: str) -> dict[str, Column]:
    """Sine and cosine of yearly (3), quarterly (2), monthly (2) and weekly (3) harmonics."""
    d = F.col(date_col)
    phases = {
        "yearly": (3, F.dayofyear(d) / 365.25),
        "quarterly": (2, (F.dayofyear(d) - (F.quarter(d) - 1) * 91.3125) / 91.3125),
        "monthly": (2, F.dayofmonth(d) / F.dayofmonth(F.last_day(d))),
        "weekly": (3, F.weekday(d) / 7.0),
    }
    out = {}
    for name, (n, phase) in phases.items():
        for k in range(1, n + 1):
            out[f"feature_sin_{name}_{k}"] = F.sin(2 * math.pi * k * phase)
            out[f"feature_cos_{name}_{k}"] = F.cos(2 * math.pi * k * phase)
    return out


def extended_date_columns(date_col: str) -> dict[str, Column]:
    """Days, weeks and months until the end of month, week (Sunday), quarter and year; on a boundary, until the next one."""
    d = F.col(date_col)
    month, quarter = F.last_day(d), F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)
    year = F.make_date(F.year(d), F.lit(12), F.lit(31))
    ends = {
        "month": F.when(d == month, F.last_day(F.date_add(d, 1))).otherwise(month),
        "week": F.next_day(d, "SUN"),
        "quarter": F.when(d == quarter, F.date_sub(F.add_months(F.trunc(d, "quarter"), 6), 1)).otherwise(quarter),
        "year": F.when(d == year, F.make_date(F.year(d) + 1, F.lit(12), F.lit(31))).otherwise(year),
    }
    out = {f"feature_days_until_{k}_end": F.datediff(end, d) for k, end in ends.items()}
    out |= {f"feature_weeks_until_{k}_end": F.datediff(ends[k], d) / 7.0 for k in ("month", "quarter", "year")}
    months = lambda end: (F.year(end) - F.year(d)) * 12 + F.month(end) - F.month(d)
    return out | {f"feature_months_until_{k}_end": months(ends[k]) for k in ("quarter", "year")}


def date_features(df: DataFrame, date_col: str, extended_dates: bool = False) -> DataFrame:
    """All calendar terms in one projection."""
    more = extended_date_columns(date_col) if extended_dates else {}
    return df.withColumns(calendar_columns(date_col) | fourier_columns(date_col) | more)


def moving_average_columns(keys: Sequence[str], date_col: str, signals: Sequence[str], windows: Sequence[int]) -> dict[str, Column]:
    return {f"{s}_ma_{w}": F.avg(s).over(trailing(keys, date_col, w)) for s in signals for w in windows}


def moving_stat_columns(keys: Sequence[str], date_col: str, signals: Sequence[str], windows: Sequence[int]) -> dict[str, Column]:
    stats = {"min": F.min, "max": F.max, "mean": F.avg}
    return {f"{s}_{n}_{w}": f(s).over(trailing(keys, date_col, w)) for s in signals for w in windows for n, f in stats.items()}


def moving_average(df: DataFrame, group_cols: str | Sequence[str], date_col: str, signal_cols: Sequence[str], window_sizes: Sequence[int]) -> DataFrame:
    return df.withColumns(moving_average_columns(names(group_cols), date_col, names(signal_cols), window_sizes))


def moving_stats(df: DataFrame, group_cols: str | Sequence[str], date_col: str, signal_cols: Sequence[str], window_sizes: Sequence[int]) -> DataFrame:
    return df.withColumns(moving_stat_columns(names(group_cols), date_col, names(signal_cols), window_sizes))


def lag_columns(keys: Sequence[str], date_col: str, signals: Sequence[str], lags: Sequence[int], mask: str = "safe", sampled: bool = True) -> dict[str, Column]:
    """Lags in rows of the series, masked on test rows.

    At the r-th test row (from 0), lag L reads history if r < L and the test window
    otherwise. ``safe`` blanks what reads the test window; ``reference`` blanks the
    history instead; ``none`` blanks nothing.
    """
    place = F.row_number().over(W.partitionBy(*keys, "sample").orderBy(date_col)) - 1 if sampled else None
    out = {}
    for s in signals:
        for n in lags:
            value = F.lag(s, n).over(ordered(keys, date_col))
            if sampled and mask != "none":
                hide = place >= n if mask == "safe" else place < n
                value = F.when((F.col("sample") == "test") & hide, None).otherwise(value)
            out[f"feature_{s}_lag_{n}"] = value
    return out


def lags(
    df: DataFrame, group_cols: str | Sequence[str], date_col: str, signal_cols: Sequence[str], lags: Sequence[int], fill_lags: bool = False, lag_mask: str = "safe"
) -> DataFrame:
    """``feature_<signal>_lag_<n>``; filled forward within the series on request."""
    keys = names(group_cols)
    made = lag_columns(keys, date_col, names(signal_cols), lags, lag_mask, "sample" in df.columns)
    out = df.withColumns(made)
    if fill_lags:
        out = out.withColumns({c: F.last(c, ignorenulls=True).over(upto(keys, date_col)) for c in made})
    return out


def signals_of(df: DataFrame, leave: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are windowed and lagged by default: doubles that no operator derived."""
    return [c for c in double_columns(df) if c not in leave and "feature_" not in c and "baseline_" not in c and not any(d in c for d in DERIVED)]


def run_feature_engineering(
    df: DataFrame, group_cols: str | Sequence[str], date_col: str, target: str, freq: str | None = None, signal_cols: Sequence[str] | None = None,
    categorical_cols: Sequence[str] | None = None, fe_window_size: Sequence[int] | None = None, lags: Sequence[int] | None = None, fill_lags: bool = False,
    n_clusters: int = 10, extended_dates: bool = False, extended_stats: bool = False, weight_type: str = "linear", lag_mask: str = "safe", cov_mode: str = "reference",
) -> DataFrame:
    """Every feature of a backtest frame. ``group_cols`` should hold the cutoff, so that replicas never mix.

    Windows of one series share one exchange and one sort; the statistics of a series are
    computed from the frame as given and joined back once. A frame that was costly to
    make should be checkpointed first.
    """
    keys = names(group_cols)
    known = frequency_params(freq)
    windows, lag_list = tuple(fe_window_size or known["fe_window_size"]), tuple(lags or known["lags"])
    categories = list(categorical_cols) if categorical_cols is not None else string_columns(df)
    signals = list(signal_cols) if signal_cols is not None else signals_of(df)
    out = encode(df, categories)
    out = date_features(out, date_col, extended_dates)
    out = periods(out, keys, date_col, target)
    made = lag_columns(keys, date_col, signals, lag_list, lag_mask)
    out = out.withColumns(moving_average_columns(keys, date_col, signals, windows) | moving_stat_columns(keys, date_col, signals, windows) | made)
    if fill_lags:
        out = out.withColumns({c: F.last(c, ignorenulls=True).over(upto(keys, date_col)) for c in made})
    out = statistics.series_statistics(out, df, keys, date_col, target, n_clusters, cov_mode, extended_stats)
    return statistics.train_weights(out, keys, "feature_periods", weight_type)
