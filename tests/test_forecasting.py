from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import baselines, guard, metrics, models
from seriesloom.plans.pipeline import Options, forecast, health, run_pipeline
from seriesloom.sources import tables
from seriesloom.streaming.panels import event_cells

START = date(2024, 1, 1)
SCHEMA = "k string, n int, date date, x double, sample string"


def rows(spark, train, test=(), k="a", n=1):
    made = [(k, n, START + timedelta(i), v, "train") for i, v in enumerate(train)]
    made += [(k, n, START + timedelta(len(train) + i), v, "test") for i, v in enumerate(test)]
    return spark.createDataFrame(made, SCHEMA)


def values(df, column):
    return [r[column] for r in df.orderBy("date").collect()]


def test_croston(spark):
    out = baselines.croston_baseline(rows(spark, [5.0, 0.0, 0.0, 3.0], [1.0, 1.0]), ["k", "n"], "date", ["x"])
    assert values(out, "baseline_x_croston") == pytest.approx([0, 5, 5, 4.0, 4.0, 4.0])


def test_baselines_without_train_rows(spark):
    df = rows(spark, [], [1.0])
    assert values(baselines.ma_baseline(df, ["k"], "date", ["x"], 3), "baseline_x_ma_3") == [None]
    assert values(baselines.croston_baseline(df, ["k"], "date", ["x"]), "baseline_x_croston") == [0.0]


def test_ma_baseline_uses_the_last_mean_that_exists(spark):
    out = baselines.ma_baseline(rows(spark, [2.0, 4.0, None], [9.0]), ["k"], "date", ["x"], 1)
    assert values(out, "baseline_x_ma_1") == [2.0, 4.0, None, 4.0]


def test_lr_baseline_one_and_many_features_agree(spark):
    df = rows(spark, [1.0, 3.0, 5.0, 7.0], [0.0]).withColumn("f", F.datediff("date", F.lit(START)).cast("double")).withColumn("g", F.lit(1.0))
    assert values(baselines.lr_baseline(df, ["k", "n"], "date", ["x"], ["f"]), "baseline_x_lr")[-1] == pytest.approx(9.0)
    assert values(baselines.lr_baseline(df, ["k", "n"], "date", ["x"], ["f", "g"]), "baseline_x_lr")[-1] == pytest.approx(9.0)
    assert values(baselines.lr_baseline(df, ["k", "n"], "date", ["x"], ["g"]), "baseline_x_lr")[-1] == pytest.approx(4.0)


def test_run_baselines_checks_its_arguments(spark):
    df = rows(spark, [1.0, 2.0], [1.0])
    with pytest.raises(ValueError):
        baselines.run_baselines(df, ["k"], "date", ["x"], ["LR"])
    with pytest.raises(ValueError):
        baselines.run_baselines(df, ["k"], "date", ["x"], ["ARIMA"])
    assert "feature_baseline_x_ma_2" in baselines.run_baselines(df, ["k"], "date", ["x"], ["MA"], 2, create_features=True).columns


@pytest.mark.parametrize(
    ("pred", "base", "want", "flag"),
    [([30, 30], [10, 10], [25, 25], True), ([1, 1], [10, 10], [4, 4], True), ([3, 3], [0, 0], [3, 3], False), ([0, 0], [10, 10], [0, 0], False), ([11, 9], [10, 10], [11, 9], False)],
)
def test_guardrail(spark, pred, base, want, flag):
    df = spark.createDataFrame([("a", START + timedelta(i), float(p), float(b)) for i, (p, b) in enumerate(zip(pred, base))], "k string, date date, prediction double, b double")
    out = guard.guardrail(df, "k", "b")
    assert values(out, "prediction") == pytest.approx(want)
    assert {r.guardrail for r in out.collect()} == {flag}
    assert values(out, "model_prediction") == pred


def test_guardrail_is_per_cutoff(spark):
    df = spark.createDataFrame([("a", START, "c1", 100.0, 10.0), ("a", START, "c2", 10.0, 10.0)], "k string, date date, cutoff string, prediction double, b double")
    assert sorted(r.prediction for r in guard.guardrail(df, "k", "b").collect()) == [10.0, 25.0]


@pytest.mark.parametrize(("i", "c", "want"), [(50.0, 0.0, 1.0), (49.9, 0.99, 2.0), (0.0, 1.0, 1.0), (None, None, 2.0)])
def test_smart_ensemble(spark, i, c, want):
    df = spark.createDataFrame([(2.0, 1.0, i, c)], "p double, b double, i double, c double")
    assert guard.smart_ensemble(df, "p", "b", "i", "c").first().prediction_ensemble == want


def test_smart_ensemble_needs_its_columns(spark):
    with pytest.raises(ValueError):
        guard.smart_ensemble(spark.range(1), "p", "b", "i", "c")


def test_outliers_keep_nulls(spark):
    out = guard.clip_outliers(rows(spark, [0.0, 1.0, 2.0, 3.0, None, 100.0]), "x", "k", 0.25, 0.75)
    assert values(out, "x") == [1.0, 1.0, 2.0, 3.0, None, 3.0]


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 16.0), (0.0, 5.0), (None, 7.0)], "a double, p double").withColumn("sample", F.lit("test"))
    got = {r.metric: r.value for r in metrics.evaluate(df, "a", ["p"]).collect()}
    assert got["RMSE"] == pytest.approx(3.1622776) and got["MAE"] == 3.0
    assert got["MAPE"] == pytest.approx(20.0) and got["WMAPE"] == pytest.approx(20.0)
    assert got["Custom Metric"] == pytest.approx(26.6666667)
    assert metrics.metric_table(df, "a", ["p"]).first().RMSE == 3.16
    empty = {r.value for r in metrics.evaluate(df.where("a > 99"), "a", ["p"]).collect()}
    assert empty <= {None}


def test_grouped_metric_wide(spark):
    df = spark.createDataFrame([(10.0, 12.0, 1), (20.0, 16.0, 2)], "a double, p double, horizon int").withColumn("sample", F.lit("test"))
    row = metrics.grouped_metric_wide(df, "a", ["p"], "horizon", only=[1, 2]).first()
    assert (row["1"], row["2"]) == (2.0, 4.0)


def test_heuristics():
    assert models.heuristic_params("LGBM", 500, 5) == {
        "maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "num_leaves": 32, "minInstancesPerNode": 5, "featureSubsetStrategy": "1.0", "subsamplingRate": 1.0, "reg_alpha": 0.0, "reg_lambda": 0.0,
    }
    assert [models.heuristic_params("LGBM", 500, f)[k] for f in (12, 30, 70, 200) for k in ("num_leaves", "reg_alpha", "reg_lambda")] == [127, 0.0, 0.0, 127, 0.01, 0.01, 127, 0.03, 0.05, 127, 0.05, 0.1]
    assert models.heuristic_params("RF", 20_000, 60)["maxDepth"] == 30
    assert models.heuristic_params("LR", 1, 1) == {"regParam": 1e-6, "solver": "normal"}


def test_mutual_information_sees_dependence():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    assert models.mutual_information(x, x + 0.1 * rng.normal(size=300)) > 1
    assert models.mutual_information(x, rng.normal(size=300)) < 0.15
    assert models.mutual_information(x[:1], x[:1]) == 0.0


@pytest.mark.parametrize("model", ["LR", "RF", "ADA"])
def test_models_learn_a_line(spark, model):
    df = spark.createDataFrame([(float(i), 2.0 * i, "train" if i < 40 else "test") for i in range(50)], "feature_a double, y double, sample string")
    params = {"LR": None, "RF": {"numTrees": 10}, "ADA": {"maxIter": 5, "maxDepth": 5}}[model]
    out = models.fit_predict(df, ["feature_a"], "y", model, params)
    worst = out.frame.where("sample = 'train'").agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert worst < (1e-3 if model == "LR" else 15)
    assert out.importances[0][0] == "feature_a"


def test_pipeline_end_to_end(spark):
    df = tables.generate_sample(spark, "W", 40)
    options = Options(horizon=3, freq="W", n_cutoffs=2, baseline_types=("MA", "CROSTON"), model="LR", lags=(1, 2), fe_window_size=(2, 4), use_guardrail=True, eval_group_col="horizon")
    out = run_pipeline(df, "date", ["product", "store"], ["sales"], options=options)
    test = out.frame.where("sample = 'test'")
    assert test.where("prediction IS NULL OR model_prediction IS NULL").count() == 0
    assert {r.horizon for r in test.select("horizon").distinct().collect()} == {1, 2, 3}
    assert {r.model for r in out.metrics.collect()} == {"baseline_sales_ma_13", "baseline_sales_croston", "prediction"}
    assert out.grouped_metrics.count() == 3 * 3
    assert out.feature_importance


def test_facade_reports_errors(spark):
    assert health()["status"] == "healthy"
    assert forecast(spark, {"data": []})["status"] == "error"


def test_sample_is_the_same_on_every_run(spark):
    a, b = (sorted(map(tuple, tables.generate_sample(spark, "MS", 12).repartition(n).collect())) for n in (1, 5))
    assert a == b and len(a) == 120 and min(r[3] for r in a) >= 0


def test_sinks_and_sources(spark, tmp_path):
    df = tables.from_records(spark, [{"date": "2024-01-01", "k": "a", "x": 1}, {"date": "2024-01-02", "k": "b", "x": 2.5}], "date")
    for fmt in ("csv", "parquet"):
        tables.write_results(df, str(tmp_path / f"r.{fmt}"), fmt)
        assert tables.read_table(spark, str(tmp_path / f"r.{fmt}")).count() == 2
    assert [len(x) for x in tables.batches([df.toArrow().to_batches()[0]] * 3, 4)] == [4, 2]


def test_streamed_cells_equal_batch_cells(spark, tmp_path):
    events = spark.createDataFrame([("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-01 11:00:00", 2.0), ("b", "2024-01-03 00:00:00", 5.0)], "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = event_cells(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "k", "v")
    running = stream.writeStream.format("memory").queryName("cells").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    got = sorted(map(tuple, spark.table("cells").collect()))
    assert got == sorted(map(tuple, event_cells(events, "ts", "k", "v").collect()))
