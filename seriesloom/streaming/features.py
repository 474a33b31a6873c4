"""Lags, trailing means and intermittent-demand forecasts of cells that arrive one by one, in any order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesloom.panel import names

DAY = 86_400_000
EPOCH = date(1970, 1, 1)
#: Cells that wait for the watermark (days and values), the last values, how many there were, and the forecast's own state.
STATE = "days array<int>, waiting array<double>, last array<double>, seen long, level double, between double, waited double"


class Series:
    """What is known of one series: it takes cells in date order and gives a row of features for each."""

    def __init__(self, lags: Sequence[int], windows: Sequence[int], alpha: float, state: tuple | None = None) -> None:
        self.lags, self.windows, self.alpha = lags, windows, alpha
        days, waiting, self.last, self.seen, self.level, self.between, self.waited = state or ([], [], [], 0, 0.0, 1.0, 1.0)
        self.waiting, self.last = dict(zip(days, waiting)), list(self.last)

    def state(self) -> tuple:
        days = sorted(self.waiting)
        return days, [self.waiting[d] for d in days], self.last, self.seen, self.level, self.between, self.waited

    def step(self, value: float) -> list[float]:
        """Features of the next cell; NaN is a missing value."""
        out = [self.last[-n] if n <= len(self.last) else np.nan for n in self.lags]
        now = [*self.last, value]
        for w in self.windows:
            known = [v for v in now[-w:] if not np.isnan(v)]
            out.append(sum(known) / len(known) if known else np.nan)
        y = 0.0 if np.isnan(value) else value
        if not self.seen:
            self.level = max(y, 0.0)
            out.append(0.0)
        else:
            if y > 0:
                self.level += self.alpha * (y - self.level)
                self.between += self.alpha * (self.waited - self.between)
            self.waited = 1.0 if y > 0 else self.waited + 1.0
            out.append(self.level / max(self.between, 1e-6))
        self.last, self.seen = now[-max([*self.lags, *(w - 1 for w in self.windows), 1]) :], self.seen + 1
        return out

    def ready(self, before: int) -> Iterator[tuple]:
        """Cells of days before ``before``, in order, with their features."""
        for day in sorted(d for d in self.waiting if d < before):
            value = self.waiting.pop(day)
            yield (EPOCH + timedelta(day), value, *self.step(value))


def stateful_features(
    cells: DataFrame, group_cols: str | Sequence[str], date_col: str, value_col: str, lags: Sequence[int] = (1, 4), windows: Sequence[int] = (4, 13), alpha: float = 0.1, late: str = "7 days"
) -> DataFrame:
    """(keys, date, value, lags, means, forecast) of a stream of cells (one per keys and date), appended as they become final.

    A cell waits until the watermark, ``late`` behind the latest date seen, has passed its
    day; then it is worked off in date order with those before it, so that the order of
    arrival does not show: the result is that of ``lags``, trailing means and
    ``croston_baseline`` over the whole table. A cell that comes again while it waits
    replaces the one before; one that comes later than the watermark is dropped by it. A
    series holds its waiting cells and as many values as its longest lag or window.
    """
    keys, lags, windows = names(group_cols), list(lags), list(windows)
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    made = [*(f"feature_{value_col}_lag_{n}" for n in lags), *(f"{value_col}_ma_{w}" for w in windows), f"baseline_{value_col}_croston"]
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField(date_col, T.DateType()), *(T.StructField(c, T.DoubleType()) for c in (value_col, *made))])
    rows = cells.select(*keys, F.to_date(date_col).alias("_day"), F.col(value_col).cast("double").alias("_value")).withColumn("_at", F.col("_day").cast("timestamp")).withWatermark("_at", late)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = Series(lags, windows, alpha, state.get if state.exists else None)
        if not state.hasTimedOut:
            for part in parts:
                series.waiting.update(zip(((d - EPOCH).days for d in part["_day"]), part["_value"].astype(float)))
        passed = state.getCurrentWatermarkMs()
        found = list(series.ready(passed // DAY))
        state.update(series.state())
        if series.waiting:  # the end of the next waiting day
            state.setTimeoutTimestamp(max((min(series.waiting) + 1) * DAY, passed + 1))
        yield pd.DataFrame([(*key, *r) for r in found], columns=schema.names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
