"""Cutoffs attached to finished windows give what windows per cutoff give."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta

import pytest

from seriesloom.functions.frequency import Frequency
from seriesloom.operators import features, preparation
from seriesloom.plans import panels


def windowed(df, keys):
    out = features.moving_stats(df, keys, "date", ["x", "filled_x"], (3, 5))
    return out.withColumns(features.lag_columns(keys, "date", ["x"], (1, 4), sampled=False))


def both_ways(df, cutoffs, horizon, freq):
    early = preparation.add_horizon(preparation.backtest(df, "date", cutoffs), "k", "date", horizon, freq)
    early = windowed(preparation.filter_by_horizon(preparation.horizon_number(early, "k", "date"), horizon), ["k", "cutoff"])
    late = preparation.late_backtest(df, "k", "date", cutoffs, horizon, freq, windowed, 5)
    return early, late


@pytest.mark.parametrize("freq,step", [("D", 1), ("W-MON", 7)])
def test_late_cutoffs_equal_early_ones(spark, freq, step):
    rng, day = random.Random(step), date(2024, 1, 1)
    rows = []
    for k, (first, n) in {"whole": (0, 40), "ends early": (0, 12), "ends between": (3, 27), "starts late": (31, 9), "starts after": (37, 3), "one row": (20, 1), "at the end": (38, 2), None: (5, 30)}.items():
        for i in range(n):
            rows.append((k, day + timedelta((first + i) * step), None if rng.random() < 0.3 else float(rng.randint(0, 9)), rng.choice(["a", "b", None]), i))
    df = spark.createDataFrame(rows, "k string, date date, x double, tag string, other int").where("k IS NOT NULL")
    df = preparation.smoothing(df, "k", "date", ["x"], 4)
    cutoffs = [day + timedelta(i * step) for i in (36, 30, 22)]
    early, late = both_ways(df, cutoffs, 4, freq)
    assert sorted(early.columns) == sorted(late.columns)
    a, b = (sorted((tuple(r) for r in d.select(*sorted(early.columns)).collect()), key=repr) for d in (early, late))
    assert len(a) > 250 and a == b


def test_monthly_panel_of_the_tables(spark):
    """The panel that queries use, with a lag mask put on by the horizon."""
    df = preparation.smoothing(preparation.complete(panels.supp_m(spark, "/root/testdata/sf0.001"), ["l_suppkey"], "date", "MS"), ["l_suppkey"], "date", ["qty"], 4)
    df = df.selectExpr("CAST(l_suppkey AS STRING) AS k", "date", "qty AS x", "filled_qty AS filled_x")
    cutoffs = preparation.cutoff_dates(df, "date", "x", 3)
    early, late = both_ways(df, cutoffs, 4, "MS")
    a, b = (sorted((tuple(r) for r in d.select(*sorted(early.columns)).collect()), key=repr) for d in (early, late))
    assert a == b and Frequency.parse("MS").family


def test_rows_that_are_there_are_carried_too(spark):
    """Text and ``filled_*`` of observed rows come from the row before where they are NULL, ahead of the windows."""
    rows = [("k", date(2024, 1, 1), 1.0, 1.0, "a"), ("k", date(2024, 1, 2), None, None, None), ("k", date(2024, 1, 3), 5.0, 5.0, None)]
    df = spark.createDataFrame(rows, "k string, date date, x double, filled_x double, tag string")
    early, late = both_ways(df, [date(2024, 1, 3)], 2, "D")
    got = {r.date.day: (r.tag, r.filled_x, round(r.filled_x_mean_3, 3)) for r in late.collect()}
    assert got == {1: ("a", 1.0, 1.0), 2: ("a", 1.0, 1.0), 3: ("a", 5.0, 2.333), 4: ("a", 5.0, 3.667)}
    a, b = (sorted((tuple(r) for r in d.select(*sorted(early.columns)).collect()), key=repr) for d in (early, late))
    assert a == b


def test_windows_are_sorted_once_and_travel_once(spark):
    df = spark.range(200).selectExpr("CAST(id % 4 AS STRING) AS k", "date_add(DATE'2024-01-01', CAST(id / 4 AS INT)) AS date", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS filled_x")
    counts = []
    for n in (1, 6):
        _, late = both_ways(df, [date(2024, 2, 1 + i) for i in range(n)], 4, "D")
        plan = late._jdf.queryExecution().sparkPlan().toString(), late._jdf.queryExecution().executedPlan().toString()
        counts.append(tuple(len(re.findall(r"Exchange hashpartitioning", p)) for p in plan))
        assert len(re.findall(r"Exchange hashpartitioning\(k#\d+, cutoff", plan[1])) == 0
    assert counts[0] == counts[1] and counts[0][1] <= 2
