from __future__ import annotations

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import features, statistics
from seriesloom.operators.columns import duplicated_names, empty_columns, feature_columns, first_matching, profile, round_half_even, sample_keys, tidy, top_series, unpivot

START = date(2024, 1, 1)


def series(spark, values, key="a", sample="train"):
    return spark.createDataFrame([(key, START + timedelta(i), v, sample) for i, v in enumerate(values)], "k string, date date, x double, sample string")


def only(df, column):
    return {r[column] for r in df.select(column).distinct().collect()}


def test_periods(spark):
    out = features.periods(series(spark, [0.0, 0.0, 5.0, 0.0, 7.0]), "k", "date", "x").orderBy("date").collect()
    assert [r.feature_periods for r in out] == [0.0, 0.0, 3.0, 4.0, 5.0]
    assert out[2].feature_periods_expanding == pytest.approx(3**1.1)


def masked(spark, mask):
    train, test = series(spark, [1.0, 2.0]), [("a", START + timedelta(2 + i), float(3 + i), "test") for i in range(4)]
    df = train.unionByName(spark.createDataFrame(test, train.schema))
    return [r.feature_x_lag_2 for r in features.lags(df, "k", "date", ["x"], [2], lag_mask=mask).orderBy("date").collect()][2:]


def test_lag_masks(spark):
    assert masked(spark, "safe") == [1.0, 2.0, None, None]
    assert masked(spark, "reference") == [None, None, 3.0, 4.0]
    assert masked(spark, "none") == [1.0, 2.0, 3.0, 4.0]


def test_filled_lags_freeze_the_last_known_value(spark):
    train, test = series(spark, [1.0, 2.0]), [("a", START + timedelta(2 + i), 9.0, "test") for i in range(3)]
    df = train.unionByName(spark.createDataFrame(test, train.schema))
    out = features.lags(df, "k", "date", ["x"], [1], fill_lags=True).orderBy("date").collect()
    assert [r.feature_x_lag_1 for r in out] == [None, 1.0, 2.0, 2.0, 2.0]


def test_zero_runs(spark):
    df = series(spark, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0, None, 0.0])
    assert only(statistics.max_consecutive_zeros(df, "k", "date", "x"), "feature_x_max_consec_zeros") == {3}
    assert only(statistics.max_consecutive_zeros(series(spark, [1.0]), "k", "date", "x"), "feature_x_max_consec_zeros") == {0}


@pytest.mark.parametrize(("values", "want"), [([1.0, 2.0, 4.0], 1.0), ([1.0, 2.0], 0.0), ([5.0] * 4, 0.0)])
def test_autocorrelation(spark, values, want):
    (got,) = only(statistics.autocorrelation(series(spark, values), "k", "date", "x"), "feature_x_autocorr_lag1")
    assert got == pytest.approx(want)


def test_intermittence(spark):
    assert only(statistics.intermittence(series(spark, [0.0, None, 2.0, 4.0]), "k", "x"), "feature_x_intermittence") == {50.0}


def test_train_weights(spark):
    df = series(spark, [0.0, 0.0, 3.0, 4.0]).withColumn("feature_periods", F.when(F.col("x") > 0, F.col("x")).otherwise(0.0))
    linear = [r.train_weight for r in statistics.train_weights(df, "k").orderBy("date").collect()]
    assert linear == [0.0, 0.0, 0.75, 1.0]
    curve = [r.train_weight for r in statistics.train_weights(df, "k", weight_type="exponential").orderBy("date").collect()]
    assert curve == pytest.approx([math.exp(-1), math.exp(-1), math.exp(-0.25), 1.0])
    none = statistics.train_weights(df.withColumn("feature_periods", F.lit(0.0)), "k")
    assert only(none, "train_weight") == {None}
    with pytest.raises(ValueError):
        statistics.train_weights(df, "k", weight_type="cubic")


def clusters(spark, means, q):
    rows = [(f"s{i}", START, m, "train") for i, m in enumerate(means)]
    out = statistics.quantile_clusters(spark.createDataFrame(rows, "k string, date date, x double, sample string"), "k", "x", q)
    return [r.feature_x_cluster for r in out.orderBy("k").collect()]


def test_quantile_clusters(spark):
    assert clusters(spark, [1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 9.0], 4) == [1, 1, 1, 1, 1, 2, 2]
    assert clusters(spark, [5.0, 5.0, 5.0], 10) == [0, 0, 0]


def test_dispersion(spark):
    (short,) = only(statistics.cov(series(spark, [2.0, 4.0, 6.0]), "k", "date", "x"), "feature_x_cov")
    assert short == pytest.approx(0.5)
    (long,) = only(statistics.cov(series(spark, [10.0, 12.0, 11.0, 13.0, 12.0, 15.0]), "k", "date", "x"), "feature_x_cov")
    assert long == pytest.approx(-1.4142136, abs=1e-6)
    (level,) = only(statistics.cov(series(spark, [10.0, 12.0, 11.0, 13.0, 12.0, 15.0]), "k", "date", "x", "level"), "feature_x_cov")
    assert level == pytest.approx(0.0883883 / (73 / 6), abs=1e-6)
    assert only(statistics.cov(series(spark, [0.0, 0.0]), "k", "date", "x"), "feature_x_cov") == {0.0}


def test_decomposition_stays_inside_its_series(spark):
    both = series(spark, [float(i + i % 2) for i in range(12)], "a").unionByName(series(spark, [1.0], "b"))
    rows = statistics.decomposition(both, "k", "date", "x", 2).collect()
    assert all(r.feature_trend_x is not None for r in rows if r.k == "a")
    assert all(r.feature_trend_x is None for r in rows if r.k == "b")


def test_each_series_has_the_period_of_its_gaps(spark):
    """Running sums give what frames give, missing values included, and each series its own period."""
    day = date(2020, 1, 1)
    steps = {"days": [timedelta(i) for i in range(40)], "weeks": [timedelta(7 * i) for i in range(130)], "months": [timedelta(int(30.44 * i)) for i in range(50)], "odd": [timedelta(3 * i) for i in range(30)], "short": [timedelta(7 * i) for i in range(60)]}
    rows = [(k, day + d, None if i % 11 == 5 else float(i + 10 * (i % 7) + i % 5)) for k, ds in steps.items() for i, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "k string, date date, x double")
    got = {(r.k, r.date): (r.feature_trend_x, r.feature_seasonal_x) for r in statistics.decomposition(df, "k", "date", "x").collect()}
    for k, p in (("days", 7), ("weeks", 52), ("months", 12), ("odd", 7)):
        for r in statistics.decomposition(df.where(F.col("k") == k), "k", "date", "x", p).collect():
            assert got[k, r.date] == pytest.approx((r.feature_trend_x, r.feature_seasonal_x), abs=1e-9)
            assert r.feature_trend_x is not None
    assert all(v == (None, None) for (k, _), v in got.items() if k == "short")


def test_encoding_numbers_nulls_last(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    assert sorted((str(r.c), r.feature_c) for r in features.encode(df, ["c"]).collect()) == [("None", 2), ("a", 0), ("b", 1), ("b", 1)]


def test_calendar_terms(spark):
    df = spark.createDataFrame([(date(2024, 3, 31),), (date(2024, 12, 31),)], "date date")
    a, b = features.date_features(df, "date", True).orderBy("date").collect()
    assert (a.feature_quarter, a.feature_dayofweek, a.feature_week) == (1, 6, 13)
    assert (a.feature_days_until_quarter_end, a.feature_days_until_month_end, a.feature_days_until_week_end) == (91, 30, 7)
    assert b.feature_days_until_year_end == 365
    assert len([c for c in a.asDict() if "sin_" in c or "cos_" in c]) == 20
    assert a.feature_sin_weekly_1 == pytest.approx(math.sin(2 * math.pi * 6 / 7))


def test_windows_share_one_exchange(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    made = features.moving_average_columns(["k"], "date", ["x"], (2, 3)) | features.moving_stat_columns(["k"], "date", ["x"], (2, 3)) | features.lag_columns(["k"], "date", ["x"], (1, 2), sampled=False)
    plan = df.withColumns(made)._jdf.queryExecution().sparkPlan().toString() + df.withColumns(made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "a", 0.125, None), (2, None, 0.375, None)], "Id int, K string, v double, e string")
    assert empty_columns(df) == ["e"]
    assert duplicated_names(df.select("Id", "Id")) == ["Id"]
    assert {r.column: r.n_missing for r in profile(df).collect()}["K"] == 1
    assert [r.v for r in round_half_even(df, ["v"]).orderBy("Id").collect()] == [0.12, 0.38]
    assert sorted(r.k for r in tidy(df, ["k"], ["v"]).collect()) == ["a", "nan"]
    wide = spark.createDataFrame([("a", 1.0, 2.0)], "k string, `2024-01` double, `2024-02` double")
    assert {(r.date, r.value) for r in unpivot(wide, ["k"]).collect()} == {("2024-01", 1.0), ("2024-02", 2.0)}
    assert feature_columns(spark.range(1).selectExpr("1 feature_a", "1 my_feature_lag_1", "1 x"), False) == ["feature_a"]
    assert first_matching(spark.range(1).selectExpr("1 feature_x_cov_y"), "feature_.*_(intermittence|cov)") == "feature_x_cov_y"


def test_top_and_sampled_series(spark):
    df = spark.createDataFrame([(f"s{i}", float(i)) for i in range(8)], "k string, x double")
    assert {r.k for r in top_series(df, ["k"], "x", 2).collect()} == {"s7", "s6"}
    assert sample_keys(df, ["k"]).count() == 2
    assert sample_keys(df, ["k"]).collect() == sample_keys(df.repartition(5), ["k"]).collect()
