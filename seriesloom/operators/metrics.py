"""Forecast errors over test rows, all models in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("RMSE", "MAE", "MAPE", "WMAPE", "Custom Metric")


def test_rows(df: DataFrame, actual: str) -> DataFrame:
    """Test rows whose actual is not 0 (a missing one passes and is left out pairwise later)."""
    return df.where((F.col("sample") == "test") & (F.col(actual).isNull() | (F.col(actual) != 0)))


def metric_columns(actual: str, model: str) -> dict[str, Column]:
    """The five metrics over rows where both values are present; NULL without such rows."""
    both = F.col(actual).isNotNull() & F.col(model).isNotNull()
    a, e = F.when(both, F.col(actual)), F.when(both, F.col(model) - F.col(actual))
    return {
        "RMSE": F.sqrt(F.avg(e * e)),
        "MAE": F.avg(F.abs(e)),
        "MAPE": 100 * F.avg(F.when(a != 0, F.abs(e / F.when(a != 0, a)))),
        "WMAPE": 100 * F.try_divide(F.sum(F.abs(e)), F.sum(a)),
        "Custom Metric": 100 * F.try_divide(F.sum(F.abs(e)) + F.abs(F.sum(e)), F.sum(a)),
    }


def evaluate(df: DataFrame, actual: str, models: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, model, metric, value): one pass, one row per model and metric."""
    rows = test_rows(df, actual)
    wide = [F.struct(*[c.alias(n) for n, c in metric_columns(actual, m).items()]).alias(f"_m{i}") for i, m in enumerate(models)]
    table = rows.groupBy(*by).agg(*wide)
    cells = [F.struct(F.lit(m).alias("model"), F.lit(n).alias("metric"), F.col(f"_m{i}.`{n}`").alias("value")) for i, m in enumerate(models) for n in METRICS]
    return table.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*")


def metric_table(df: DataFrame, actual: str, models: Sequence[str], digits: int = 2) -> DataFrame:
    """A row per model, baseline first as given, a column per metric, rounded half to even."""
    wide = evaluate(df, actual, models).groupBy("model").pivot("metric", list(METRICS)).agg(F.first("value"))
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    return wide.select("model", *[F.bround(F.col(f"`{n}`"), digits).alias(n) for n in METRICS]).orderBy(place)


def grouped_metric(df: DataFrame, actual: str, models: Sequence[str], group_col: str, metric: str = "RMSE", only: Sequence | None = None) -> DataFrame:
    """(group, model, value) of one metric for each value of a column, tidy; ``only`` keeps some values."""
    rows = df if only is None else df.where(F.col(group_col).isin(list(only)))
    return evaluate(rows, actual, models, [group_col]).where(F.col("metric") == metric).select(group_col, "model", "value")


def grouped_metric_wide(df: DataFrame, actual: str, models: Sequence[str], group_col: str, metric: str = "RMSE", only: Sequence | None = None, digits: int = 2) -> DataFrame:
    """As ``grouped_metric`` with a column per group value."""
    tidy = grouped_metric(df, actual, models, group_col, metric, only)
    return tidy.groupBy("model").pivot(group_col, list(only) if only else None).agg(F.bround(F.first("value"), digits))
