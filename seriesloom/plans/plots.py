"""What plots show, aggregated in Spark; drawn where matplotlib is installed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.columns import rollup, top_series
from seriesloom.panel import names

try:
    import matplotlib.pyplot as plt
except ImportError:
    plt = None


def series_lines(df: DataFrame, date_col: str, by: str, value: str, how: str = "mean") -> DataFrame:
    """One line per value of ``by``: the mean or sum of the signal on each date."""
    return rollup(df, [date_col, by], value, how)


def forecast_lines(df: DataFrame, date_col: str, values: Sequence[str], group_cols: Sequence[str] | None = None, target: str | None = None, top: int | None = None) -> DataFrame:
    """Totals of actuals and forecasts by cutoff, sample and date, over all series or the ``top`` largest."""
    rows = top_series(df, names(group_cols), target, top) if top and group_cols and target else df
    return rows.groupBy("cutoff", "sample", date_col).agg(*[F.sum(v).alias(v) for v in values])


def choice_shares(stats: DataFrame) -> DataFrame:
    """How many series go with the prediction and how many with the baseline."""
    return stats.groupBy("decision").agg(F.count("*").alias("n_series"))


def draw_lines(lines: DataFrame, x: str, y: Sequence[str], color: str | None = None, path: str | None = None):
    """Draws an aggregated frame (as many rows as dates and lines); saves it where a path is given."""
    if plt is None:
        raise RuntimeError("matplotlib is not installed")
    table = lines.orderBy(x).toPandas()
    figure, axes = plt.subplots(figsize=(12, 5))
    groups = table.groupby(color) if color else [("", table)]
    for name, part in groups:
        for column in names(y):
            axes.plot(part[x], part[column], label=f"{name} {column}".strip())
    axes.legend()
    if path:
        figure.savefig(path)
    return figure


def draw_importance(rows: list[dict], path: str | None = None, top: int = 20):
    """Bars of the mean importance of each feature with its deviation."""
    if plt is None:
        raise RuntimeError("matplotlib is not installed")
    shown = rows[:top][::-1]
    figure, axes = plt.subplots(figsize=(8, 6))
    axes.barh([r["feature"] for r in shown], [r["mean"] for r in shown], xerr=[r["std"] for r in shown])
    if path:
        figure.savefig(path)
    return figure
