"""Completion, horizons and statistics of a series read it once, and give what joins over all rows gave."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriesloom.functions.frequency import Frequency
from seriesloom.operators import preparation, statistics
from seriesloom.plans import pipeline, queries


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    """Dates off the grid, twice, missing, alone, and keys without any date or without a key."""
    day = date(2024, 1, 3)
    rows = [("a", day + timedelta(d), float(d % 3)) for d in (0, 1, 1, 4, 5, 9, 28, 31, 60, 150, 151, 400)]
    rows += [("b", day + timedelta(3), 1.0), ("c", None, 2.0), ("c", None, 3.0), ("d", None, 1.0), ("d", day, None), ("d", day + timedelta(40), 0.0), (None, day, 1.0)]
    rows += [("e", date(2024, 3, 31), 1.0), ("e", date(2024, 6, 30), None), ("f", date(2024, 2, 1), 0.0), ("f", date(2024, 2, 3), 5.0)]
    return spark.createDataFrame(rows, "k string, date date, x double")


@pytest.mark.parametrize("freq", ["D", "3D", "B", "W-WED", "W", "MS", "M", "SM", "Q", "Y"])
def test_completion_is_the_grid_joined(spark, odd, freq):
    kept = odd.dropna(subset=["k"])
    ends = kept.groupBy("k").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = ends.select("k", F.explode(Frequency.parse(freq).grid(F.col("lo"), F.col("hi"))).alias("date"))
    want = grid.join(kept, ["k", "date"], "left").select("k", "date", "x")
    got = preparation.complete(odd, "k", "date", freq)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Join" not in plan(got)


@pytest.mark.parametrize("freq", ["D", "W-WED", "MS"])
def test_horizons_are_the_missing_dates_joined(spark, odd, freq):
    df = odd.where("k IS NOT NULL AND date IS NOT NULL").withColumn("tag", F.col("k")).withColumn("filled_x", F.col("x"))
    df = preparation.backtest(df, "date", [date(2024, 1, 31), date(2024, 1, 1), date(2025, 3, 1)])
    future = F.explode(Frequency.parse(freq).future(F.col("cutoff"), 4))
    missing = df.select("k", "cutoff").distinct().withColumn("date", future).join(df.select("k", "cutoff", "date"), ["k", "cutoff", "date"], "left_anti")
    want = df.select("k", "cutoff", "date", "sample", "x").unionByName(missing.select("k", "cutoff", "date", F.lit("test").alias("sample"), F.lit(None).cast("double").alias("x")))
    got = preparation.add_horizon(df, "k", "date", 4, freq)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert got.where("tag IS NULL OR tag <> k").where("date > cutoff AND sample = 'test' AND cutoff > DATE'2025-01-01'").isEmpty()
    assert "Join" not in plan(got) and "Union" not in plan(got)


def test_statistics_of_a_series_need_no_join_of_its_rows(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([0, 0, 1, 0, 0, 0, 2])] + [("b", 0, 1.0), ("c", 0, 0.0), ("c", 1, None), ("c", 2, 0.0), (None, 0, 0.0)]
    df = spark.createDataFrame(rows, "k string, i int, x double").selectExpr("k", "date_add(DATE'2024-01-01', i) AS date", "x")
    runs = statistics.zero_runs(df, "k", "date", "x")
    assert {r[0]: r[1] for r in runs.collect()} == {"a": 3, "b": 0, "c": 1, None: 1}
    assert "Join" not in plan(runs) and plan(queries.max_zero_run(spark, "/root/testdata/sf0.001")).count("Join") == 0
    marks = spark.sparkContext.accumulator(0)
    counted = df.rdd.map(lambda r: (marks.add(1), r)[1]).toDF(df.schema)
    buckets = statistics.intermittence_buckets(counted, "k", "date", "x", 2)
    assert {r[0]: r[1] for r in buckets.collect()}["b"] >= 1 and marks.value == len(rows)  # read once


def test_a_pipeline_without_a_model_writes_its_frame_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(pipeline, "materialize", lambda df: written.append(df.columns) or df.localCheckpoint())
    rows = queries._pipeline_without_model(spark, "/root/testdata/sf0.001")
    assert len(written) == 1 and rows.metrics.count() == 5
    assert sorted(map(tuple, rows.cutoff_stats.collect())) == sorted(map(tuple, preparation.cutoff_statistics(rows.frame).collect()))
