from __future__ import annotations

import datetime

import numpy as np

from pyspark.sql import functions as F

from seriesloom.operators import baselines, models


def test_boosted_baseline_does_not_learn_from_its_own_answers(spark):
    rows, first = [], datetime.date(2024, 1, 1)
    for cutoff in (60, 70):
        for key, level in (("a", 10.0), ("b", 500.0)):
            for i in range(80):
                y = level + (i % 7 >= 3) * level + (1e6 if 60 <= i < 70 else 0.0)  # a later cutoff trains on these days
                if cutoff == 70 or i < 70:
                    rows.append((key, str(cutoff), first + datetime.timedelta(i), "train" if i < cutoff else "test", y, float(i), float(i % 7)))
    df = spark.createDataFrame(rows, "k string, cutoff string, date date, sample string, y double, f1 double, f2 double")
    out = baselines.boosted_baseline(df, ["k"], "date", ["y"], ["f1", "f2"]).where("cutoff = '60'").collect()
    for r in out:
        level = 10.0 if r.k == "a" else 500.0
        want = r.y if r.sample == "train" else level + (r.f2 >= 3) * level
        assert abs(r.baseline_y_lgbm - want) < 0.05 * level, r


def test_features_are_scored_over_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=2600)
    y = np.where(np.arange(2600) < 600, x * 5, rng.normal(size=2600))  # only the first rows tell
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "k string, f double, y double").coalesce(1)
    score = models.feature_scores(df, ["k"], ["f"], "y", share=1.0).first().score
    dx, dy = (np.abs(v[:, None] - v) for v in ((x - x.mean()) / x.std(), (y - y.mean()) / y.std()))
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.inf)
    r = np.partition(both, 2, axis=1)[:, 2][:, None]
    psi = lambda m: np.r_[0, np.cumsum(1 / np.arange(1, 2601))][np.maximum(m, 1) - 1] - 0.5772156649015329
    want = psi(np.array([2600]))[0] + psi(np.array([3]))[0] - (psi((dx < r).sum(1)) + psi((dy < r).sum(1))).mean()
    assert abs(score - max(0.0, want)) < 1e-9


def test_backtests_tune_on_dates_with_the_whole_draw(spark, monkeypatch):
    rows = [("a", "c", datetime.date(2024, 1, 1) + datetime.timedelta(i), "train" if i < 40 else "test", float(i), float(i % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, cutoff string, day date, sample string, y double, f double")
    asked, search = [], models.tuning.search
    monkeypatch.setattr(models.tuning, "search", lambda *a, **b: asked.append((a[0].agg(F.max("day")).first()[0], *a[4:])) or search(*a, **b))
    models.run_backtesting(df, ["k", "cutoff"], ["f"], "y", tune_hyperparameters=True, date_col="day", n_candidates=5)
    assert asked == [(datetime.date(2024, 2, 9).toordinal() * 86_400_000_000 - datetime.date(1970, 1, 1).toordinal() * 86_400_000_000, "halving", 5)]
    tried, tune = [], models.tune_parameters
    monkeypatch.setattr(models, "estimator", lambda model, y, p, *a: tried.append(p["i"]) or models.LinearRegression(featuresCol="features", labelCol="_y"))
    train = models.VectorAssembler(inputCols=["f"], outputCol="features").transform(df.where("sample = 'train'")).withColumnRenamed("y", "_y")
    tune(train, "GBM", candidates=[{"i": i} for i in range(12)], search="random", folds=1, date_col="day")
    assert sorted(tried) == list(range(12))
