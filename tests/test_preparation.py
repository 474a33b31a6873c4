from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriesloom.functions.frequency import Frequency, detect_frequency, frequency_params
from seriesloom.operators import preparation as P
from seriesloom.panel import PanelSpec, ingest

D = date


def panel(spark, rows, schema="k string, date date, x double"):
    return spark.createDataFrame(rows, schema)


def dates(spark, f, lo, hi):
    return spark.range(1).select(Frequency.parse(f).grid(F.lit(lo), F.lit(hi)).alias("d")).first().d


def test_weekly_grid_fills_the_gap(spark):
    df = panel(spark, [("a", D(2024, 1, d), 1.0) for d in (1, 8, 22)])
    rows = P.complete(df, "k", "date", "W-MON").orderBy("date").collect()
    assert [r.date.day for r in rows] == [1, 8, 15, 22]
    assert rows[2].x is None


def test_empty_grid_keeps_the_first_date(spark):
    df = panel(spark, [("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 3), 2.0)])
    assert [(r.date, r.x) for r in P.complete(df, "k", "date", "W").collect()] == [(D(2024, 1, 1), 1.0)]


def test_rows_off_the_grid_are_lost(spark):
    df = panel(spark, [("a", D(2024, 1, d), 1.0) for d in (6, 13, 20)])
    assert all(r.x is None for r in P.complete(df, "k", "date", "W").collect())


@pytest.mark.parametrize(
    ("f", "lo", "hi", "want"),
    [
        ("D", D(2024, 2, 27), D(2024, 3, 1), [(2, 27), (2, 28), (2, 29), (3, 1)]),
        ("3D", D(2024, 1, 1), D(2024, 1, 8), [(1, 1), (1, 4), (1, 7)]),
        ("B", D(2024, 1, 5), D(2024, 1, 9), [(1, 5), (1, 8), (1, 9)]),
        ("W-SAT", D(2024, 1, 1), D(2024, 1, 14), [(1, 6), (1, 13)]),
        ("MS", D(2024, 1, 15), D(2024, 3, 1), [(2, 1), (3, 1)]),
        ("M", D(2024, 1, 31), D(2024, 3, 31), [(1, 31), (2, 29), (3, 31)]),
        ("Q", D(2024, 1, 1), D(2024, 7, 1), [(3, 31), (6, 30)]),
        ("SM", D(2024, 1, 10), D(2024, 2, 20), [(1, 15), (1, 31), (2, 15)]),
        ("Y", D(2024, 1, 1), D(2024, 12, 31), [(12, 31)]),
    ],
)
def test_grids(spark, f, lo, hi, want):
    assert [(d.month, d.day) for d in dates(spark, f, lo, hi)] == want


@pytest.mark.parametrize("f", ["D", "2D", "B", "W-WED", "MS", "M", "Q", "SM", "Y"])
def test_future_has_n_dates_after_the_first_on_grid(spark, f):
    row = spark.range(1).select(Frequency.parse(f).future(F.lit(D(2024, 1, 3)), 5).alias("d"), Frequency.parse(f).on_grid(F.lit(D(2024, 1, 3))).alias("g")).first()
    assert len(row.d) == 5 and row.d[0] > row.g and row.d == sorted(row.d)


def test_off_grid_cutoff_skips_one_date(spark):
    row = spark.range(1).select(Frequency.parse("W").future(F.lit(D(2024, 1, 3)), 3).alias("d")).first()
    assert [d.day for d in row.d] == [14, 21, 28]


def test_unknown_frequency():
    with pytest.raises(ValueError):
        Frequency.parse("fortnight")


def test_smoothing_and_clipping(spark):
    rows = [("a", D(2024, 1, i + 1), x) for i, x in enumerate([1.0, None, 3.0, None, None, None])] + [("b", D(2024, 1, 1), -2.0), ("b", D(2024, 1, 2), None)]
    out = P.smoothing(panel(spark, rows), "k", "date", ["x"], 3).orderBy("k", "date").collect()
    assert [r.filled_x for r in out] == [1.0, 1.0, 3.0, 3.0, 3.0, None, 0.0, 0.0]


def test_unfillable_null_is_not_zero(spark):
    out = P.smoothing(panel(spark, [("a", D(2024, 1, 1), None)]), "k", "date", ["x"], 2).first()
    assert out.filled_x is None


def test_cutoffs(spark):
    df = panel(spark, [("a", D(2024, 1, 1) + timedelta(7 * i), 1.0) for i in range(13)])
    assert P.cutoff_dates(df, "date", "x", 3) == [D(2024, 3, 25), D(2024, 3, 4), D(2024, 2, 5)]
    with pytest.raises(ValueError):
        P.cutoff_dates(df.where("x > 5"), "date", "x", 1)


def test_horizons(spark):
    df = panel(spark, [("a", D(2024, 1, 1) + timedelta(7 * i), 1.0) for i in range(5)])
    out = P.add_horizon(P.backtest(df, "date", [D(2024, 1, 29)]), "k", "date", 3, "W-MON")
    out = P.horizon_number(out, "k", "date")
    test = out.where("sample = 'test'").orderBy("date").collect()
    assert [(r.date.day, r.horizon) for r in test] == [(29, 1), (5, 2), (12, 3), (19, 4)]
    assert P.filter_by_horizon(out, 3).count() == 4 + 3
    assert P.forecast_lag(out, "k", "date").where("sample = 'train' AND fcst_lag IS NOT NULL").count() == 0


@pytest.mark.parametrize(
    ("days", "want"),
    [([0, 1, 2, 3], "D"), ([0, 7, 14, 21], "W-MON"), ([0, 7, 8, 9, 16], "W"), ([0], "D"), ([0, 5, 10], "5D"), ([0, 365, 730], "Y"), ([0, 31, 60, 91], "MS")],
)
def test_detect_frequency(spark, days, want):
    df = panel(spark, [("a", D(2024, 1, 1) + timedelta(d), 1.0) for d in days])
    assert detect_frequency(df, "date") == want


def test_defaults_know_anchored_weeks():
    assert frequency_params("W-SAT")["lags"] == (13, 26, 39, 52)
    assert frequency_params(None)["horizon"] == 4


def test_ingest_treats_nan_as_null(spark):
    df = panel(spark, [("a", D(2024, 1, 1), float("nan")), ("a", D(2024, 1, 2), None), (None, D(2024, 1, 3), 1.0)])
    rows = ingest(df, PanelSpec(("k",), "date", ("x",))).collect()
    assert [r.x for r in rows] == [None, None]


def test_preparation_does_not_depend_on_partitions(spark):
    rows = [(k, D(2024, 1, 1) + timedelta(7 * i), float(i % 4)) for k in "abc" for i in range(30) if i % 7]
    df = panel(spark, rows)
    run = lambda d: sorted(map(tuple, P.run_data_preparation(d, "date", "k", ["x"], horizon=4, freq="W-MON", n_cutoffs=2).collect()), key=str)
    assert run(df.repartition(1)) == run(df.repartition(7))
