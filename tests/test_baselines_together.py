"""Baselines of many series at once equal those of each series by itself."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from seriesloom.operators import baselines, boosting


@pytest.mark.parametrize("sizes", [[2, 3, 1, 0, 17, 80, 80, 33], [5], [0, 1]])
def test_lines_equal_numpy_series_by_series(sizes):
    rng, number = np.random.default_rng(1), np.repeat(np.arange(len(sizes)), sizes)
    t = np.concatenate([np.arange(n) for n in sizes]).astype(float)
    x = np.column_stack([np.ones(len(t)), t, np.sin(t / 6), np.zeros(len(t)), 2 * t])  # columns that say nothing new
    y = rng.normal(50, 20, len(t))
    got = baselines.least_squares(x, y, number, len(sizes))
    for k, n in enumerate(sizes):
        own = number == k
        assert np.allclose(got[k], np.linalg.lstsq(x[own], y[own], rcond=None)[0], atol=1e-8) if n > 1 else np.isnan(got[k]).all()


def test_lines_need_no_join_and_no_group_in_pandas(spark):
    rows = [(k, datetime.date(2024, 1, 1) + datetime.timedelta(i), "train" if i < 9 else "test", float(i * i), float(i), float(i % 3)) for k in ("a", "b", None) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, date date, sample string, y double, f double, g double")
    out = baselines.lr_baseline(df, ["k"], "date", ["y"], ["f", "g"])
    text = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in text and "Pandas" not in text
    x = np.array([[1, i, i % 3] for i in range(12)], float)
    c = np.linalg.lstsq(x[:9], np.arange(9.0) ** 2, rcond=None)[0]
    for r in out.collect():
        assert abs(r.baseline_y_lr - (r.y if r.sample == "train" else x[int(r.f)] @ c)) < 1e-6


def test_short_series_share_the_work(monkeypatch):
    """Short series take table steps whose number does not grow with the series; long ones grow leaf by leaf, and both agree."""
    calls, short = [], boosting._short_series
    monkeypatch.setattr(boosting, "_short_series", lambda *a: calls.append(a[5]) or short(*a))
    rng = np.random.default_rng(2)
    sizes = [79] * 50 + [70] * 20 + [700, 1, 45]
    number = np.repeat(np.arange(len(sizes)), sizes)
    x = np.column_stack([np.concatenate([np.arange(n) for n in sizes]), rng.integers(0, 12, len(number))]).astype(float)
    y = np.round(rng.normal(10, 5, len(number)) + x[:, 1], 1)
    ask = np.repeat(np.arange(len(sizes)), 3)
    q = np.column_stack([rng.integers(0, 90, len(ask)), rng.integers(0, 12, len(ask))]).astype(float)
    got = boosting.boosted_series(x, y, number, q, ask, len(sizes), 15, 0.1)
    assert sorted(calls) == [1, 71] or sum(calls) == 72
    for k in (0, 49, 50, 69, 70, 71, 72):
        alone = boosting.boosted_series(x[number == k], y[number == k], np.zeros(sizes[k], int), q[ask == k], np.zeros(3, int), 1, 15, 0.1)
        assert np.allclose(got[ask == k], alone)
