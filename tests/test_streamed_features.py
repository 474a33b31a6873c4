"""A stream that is replayed in several orders ends in the result over the whole table."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import baselines, features
from seriesloom.streaming.features import Series, stateful_features

SCHEMA = "k string, date date, x double"


@pytest.fixture(scope="module")
def cells():
    rng = random.Random(1)
    return [(k, date(2024, 1, 1) + timedelta(i), rng.choice([None, 0.0, 0.0, float(rng.randint(1, 9))])) for k in "abc" for i in range(0, 40, 1 if k != "c" else 3)]


def batch(spark, cells):
    df = spark.createDataFrame(cells, SCHEMA).withColumn("sample", F.lit("train"))
    df = baselines.croston_baseline(features.moving_average(df, "k", "date", ["x"], (3, 5)), "k", "date", ["x"])
    df = features.lags(df.drop("sample"), "k", "date", ["x"], (1, 2))
    return sorted(map(tuple, df.select("k", "date", "x", "feature_x_lag_1", "feature_x_lag_2", "x_ma_3", "x_ma_5", "baseline_x_croston").collect()), key=repr)


@pytest.mark.parametrize("order", ["as dated", "shuffled a little", "backwards"])
def test_any_order_gives_the_batch_result(spark, cells, tmp_path, order):
    rng = random.Random(2)
    rows = {"as dated": lambda r: r[1].toordinal(), "shuffled a little": lambda r: r[1].toordinal() + rng.random() * 6, "backwards": lambda r: -r[1].toordinal()}[order]
    ordered = sorted(cells, key=rows)
    lots = [ordered[i : i + 25] for i in range(0, len(ordered), 25)]
    for i, lot in enumerate([*lots, [("end", date(2026, 1, 1), 1.0)], [("end", date(2026, 1, 2), 1.0)]]):
        spark.createDataFrame(lot, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    out = stateful_features(stream, "k", "date", "x", (1, 2), (3, 5), late="60 days" if order == "backwards" else "7 days")
    name = f"features_{order.split()[-1]}"
    run = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = sorted(map(tuple, spark.table(name).where("k <> 'end'").collect()), key=repr)
    want = batch(spark, cells)
    assert len(got) == len(want) == len(cells)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], abs=1e-9, nan_ok=True)


def test_a_series_keeps_as_much_as_it_needs():
    one = Series([1, 4], [3], 0.1)
    for i in range(50):
        one.waiting[i] = float(i)
    assert [r[1] for r in one.ready(30)] == [float(i) for i in range(30)] and len(one.last) == 4 and len(one.waiting) == 20
    other = Series([1, 4], [3], 0.1, one.state())
    assert list(other.ready(50)) == list(one.ready(50)) and other.seen == 50
