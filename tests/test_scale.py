from __future__ import annotations

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.frequency import aligned
from seriesloom.functions.ranks import running_before
from seriesloom.operators import features, models, preparation, statistics
from seriesloom.plans.pipeline import Options, forecast, run_pipeline
from seriesloom.sources import tables


def single_task_windows(df):
    """Windows of the plan that one task would have to sort."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange SinglePartition, ENSURE_REQUIREMENTS.*\n.*Window", plan) + ["window"] * ("No Partition Defined" in plan)


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(v), int(a)) for v, a in zip(rng.permutation(500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "v int, a int").repartition(7)
    got = {r.v: (r.before, r.place) for r in running_before(df, [F.col("v").asc()], {"before": F.col("a"), "place": F.lit(1)}).collect()}
    total = 0
    for place, (v, a) in enumerate(sorted(rows)):
        assert got[v] == (total, place)
        total += a
    assert running_before(df.where("false"), [F.col("v").asc()], {"before": F.lit(1)}).count() == 0


def test_codes_and_edges_need_no_single_task(spark):
    df = spark.createDataFrame([(c, "x", float(i)) for i, c in enumerate(["b", "a", None, "c", "a"])], "k string, g string, v double")
    out = features.encode(df, ["k"])
    assert sorted((r.k or "", r.feature_k) for r in out.collect()) == [("", 3), ("a", 0), ("a", 0), ("b", 1), ("c", 2)]
    assert not single_task_windows(out)
    assert not single_task_windows(statistics.quantile_clusters(df, ["k"], "v", 3))


@pytest.mark.parametrize("q", [1, 3, 4, 10])
def test_edges_equal_interpolated_quantiles(spark, q):
    rng = np.random.default_rng(q)
    groups = {"a": rng.integers(0, 6, 40).astype(float), "b": rng.normal(size=33), None: np.array([2.5]), "d": np.array([1.0, 1.0, 1.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("only null", None)]
    df = spark.createDataFrame(rows, "cutoff string, v double").repartition(5)
    got = {r["_by_cutoff"]: r["_edges"] for r in statistics.quantile_edges(df, "v", q, ["cutoff"]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g] == pytest.approx(sorted(set(np.quantile(v, np.arange(q + 1) / q).tolist())), abs=1e-12)
    assert statistics.bucket(df.where("cutoff = 'only null'"), "v", q, "c").first().c == 0
    assert statistics.bucket(df.where("false"), "v", q, "c").count() == 0


def test_weeks_follow_the_data(spark):
    saturdays = [datetime.date(2024, 1, 6) + datetime.timedelta(7 * i) for i in range(20)]
    df = spark.createDataFrame([("a", d, 1.0 + i) for i, d in enumerate(saturdays)], "k string, date date, y double")
    assert aligned("W", df, "date") == "W-SAT" and aligned("w-mon", df, "date") == "w-mon" and aligned("W", df.where("false"), "date") == "W"
    out = preparation.run_data_preparation(df, "date", ["k"], ["y"], horizon=3, freq="W", n_cutoffs=1)
    assert out.where("sample = 'train' AND y IS NULL").isEmpty() and out.where("sample = 'train'").count() == 19


@pytest.mark.parametrize("scoring", ["neg_mean_squared_log_error", "neg_mean_squared_error", "neg_root_mean_squared_error", "neg_mean_absolute_error", "neg_median_absolute_error", "r2"])
def test_scores(spark, scoring):
    a, p = np.array([1.0, 2.0, 5.0]), np.array([1.5, -1.0, 4.0])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, p)], "a double, p double")
    e = p - a
    want = {
        "neg_mean_squared_log_error": -np.mean((np.log1p(np.maximum(p, 0)) - np.log1p(a)) ** 2),
        "neg_mean_squared_error": -np.mean(e**2),
        "neg_root_mean_squared_error": -np.sqrt(np.mean(e**2)),
        "neg_mean_absolute_error": -np.mean(np.abs(e)),
        "neg_median_absolute_error": -np.median(np.abs(e)),
        "r2": 1 - np.mean(e**2) / np.var(a),
    }[scoring]
    assert df.agg(models.score_column(scoring, F.col("a"), F.col("p"))).first()[0] == pytest.approx(want)
    with pytest.raises(ValueError):
        models.score_column("accuracy", F.col("a"), F.col("p"))


def test_the_best_candidate_is_found_and_reruns_agree(spark):
    first = datetime.date(2024, 1, 1)
    rows = [(first + datetime.timedelta(i), float(i % 6), float(10 * (i % 6 > 2) + 100 * (i % 2))) for i in range(120)]
    train = models.VectorAssembler(inputCols=["f"], outputCol="features").transform(spark.createDataFrame(rows, "date date, f double, _y double"))
    space = {"maxIter": [1], "maxDepth": [1, 4], "stepSize": [1.0]}  # one split cannot tell six values apart
    for search in ("grid", "random", "halving"):
        found = [models.tune_parameters(train, "GBM", search=search, folds=2, date_col="date", param_distributions=space, scoring="neg_mean_squared_error") for _ in range(2)]
        assert found[0] == found[1] == {"maxIter": 1, "maxDepth": 4, "stepSize": 1.0}


def test_adaboost_keeps_its_lineage_short(spark, monkeypatch):
    cuts, write = [], models.materialize
    monkeypatch.setattr(models, "materialize", lambda df: cuts.append(1) or write(df))
    rng = np.random.default_rng(6)
    rows = [(models_vector(x), float(x[0] * 3 + x[1] ** 2 + rng.normal())) for x in rng.normal(size=(80, 2))]
    df = spark.createDataFrame(rows, ["features", "_y"])
    fitted = models.fit_adaboost(df, "_y", {"maxIter": 9, "stepSize": 0.5, "maxDepth": 2}, None, 1)
    assert len(fitted.trees) > 4 and len(cuts) == len(fitted.trees) // models.CUT


def models_vector(x):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense(x.tolist())


def test_sinks_write_what_the_response_holds(spark, tmp_path):
    df = tables.generate_sample(spark, "W", 40, products=2, stores=1)
    options = Options(horizon=3, freq="W", n_cutoffs=2, baseline_types=("MA", "LR", "ML"), fe_window_size=(2,), lags=(1, 2), bs_window_size=4, model=None)
    out = run_pipeline(df, "date", ["product", "store"], ["sales"], options=options)
    assert out.baseline_columns == ["baseline_sales_ma_4", "baseline_sales_lr", "baseline_sales_lgbm"]
    tables.write_metrics(out.metrics, str(tmp_path / "m"))
    wide = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert wide.columns == ["model", *tables.METRICS] and wide.count() == 3 and wide.where("RMSE IS NULL").isEmpty()
    assert tables.write_cutoff_statistics(out.cutoff_stats, str(tmp_path / "c")) and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert not tables.write_cutoff_statistics(out.cutoff_stats.limit(1), str(tmp_path / "d"))


def test_samples_may_start_somewhere(spark):
    out = tables.generate_sample(spark, "D", 10, start=datetime.date(2024, 2, 25)).agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert tuple(out) == (datetime.date(2024, 2, 25), datetime.date(2024, 3, 5), 100)


def test_a_request_may_be_a_frame(spark):
    df = tables.generate_sample(spark, "D", 40, products=1, stores=2)
    request = {"date_col": "date", "group_cols": ["product", "store"], "signal_cols": ["sales"], "freq": "D", "horizon": 2, "lags": (1,), "fe_window_size": (2,), "model": None}
    whole = forecast(spark, request | {"data": df})
    listed = forecast(spark, request | {"data": [r.asDict() | {"date": r.date.isoformat()} for r in df.collect()]})
    assert whole["status"] == listed["status"] == "success", (whole, listed)
    assert whole["predictions"].count() == len(listed["predictions"]) > 0
