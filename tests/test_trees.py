"""Boosted trees on arrays and over executors, and many models in one job."""

from __future__ import annotations

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import baselines, columns, fits, groups, models, pooled, trees, tuning
from seriesloom.operators.boosting import boosted_series


def planted(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.integers(0, 25, n), rng.integers(0, 3, n), rng.normal(size=n).round(1)].astype(float)
    return x, 2 * x[:, 0] + 9 * (x[:, 1] > 1) + x[:, 2] + rng.normal(0, 0.5, n)


def naive_tree(x, rest, w, g):
    """Grows one tree in the plainest way; a function from rows to values."""
    soft = lambda v: np.sign(v) * max(abs(v) - g.l1, 0)
    part = lambda own: soft((w[own] * rest[own]).sum()) ** 2 / (w[own].sum() + g.l2)

    def best(own, depth):
        found = (1e-12, None)
        if g.depth and depth >= g.depth:
            return found
        for f in range(x.shape[1]):
            v = x[own, f]
            for edge in np.unique(v[~np.isnan(v)]):
                for missing in (True, False) if np.isnan(v).any() else (True,):
                    low = np.where(np.isnan(v), missing, v <= edge).astype(bool)
                    if min(low.sum(), (~low).sum()) >= max(g.least, 1):
                        gain = part(own[low]) + part(own[~low]) - part(own)
                        if gain > found[0] * (1 + 1e-9) + 1e-12:
                            found = (gain, (f, edge, missing, low))
        return found

    grown = [(best(np.arange(len(rest)), 0), np.arange(len(rest)), 0)]
    while len(grown) < g.leaves:
        j = max(range(len(grown)), key=lambda j: grown[j][0][0])
        (gain, split), own, depth = grown[j]
        if split is None:
            break
        grown[j : j + 1] = [(best(o, depth + 1), o, depth + 1) for o in (own[split[3]], own[~split[3]])]
    out = np.zeros(len(rest))
    for _, own, _ in grown:
        out[own] = soft((w[own] * rest[own]).sum()) / (w[own].sum() + g.l2)
    return out


@pytest.mark.parametrize("case", [{}, {"l1": 30.0}, {"l2": 25.0}, {"depth": 2}, {"leaves": 4}, {"least": 30}, {"l1": 5.0, "l2": 3.0, "depth": 3, "leaves": 6}])
def test_trees_equal_plain_ones(case):
    x, y = planted(140)
    x[::7, 0], x[3::11, 2] = np.nan, np.nan
    w = np.random.default_rng(2).integers(1, 4, len(y)).astype(float)
    g = trees.Growth(**({"trees": 5, "rate": 0.3, "leaves": 12, "least": 6} | case))
    want, start = np.zeros(len(y)), np.average(y, weights=w)
    for _ in range(g.trees):
        want += g.rate * naive_tree(x, y - start - want, w, g)
    assert np.allclose(trees.fit_arrays(x, y, w, g).predict(x), start + want)


def test_trees_equal_the_ones_of_a_series():
    (x, y), (ask, _) = planted(150), planted(40, 5)
    g = trees.Growth(trees=20, rate=0.1, leaves=15, least=8)
    want = boosted_series(x, y, np.zeros(150, int), ask, np.zeros(40, int), 1, 20, 0.1, 15, 8)
    assert np.allclose(trees.fit_arrays(x, y, np.ones(150), g).predict(ask), want)


def test_missing_values_learn_their_branch():
    x = np.r_[np.arange(40.0), np.full(20, np.nan)][:, None]
    y = np.r_[np.arange(40.0), np.full(20, 39.0)]
    model = trees.fit_arrays(x, y, np.ones(60), trees.Growth(trees=200, rate=0.2, leaves=8, least=2))
    assert abs(model.predict(np.array([[np.nan]]))[0] - 39) < 0.5 and abs(model.predict(np.array([[0.0]]))[0]) < 1


def test_leaves_penalties_and_shares_take_effect():
    x, y = planted(300)
    fit = lambda **k: trees.fit_arrays(x, y, np.ones(300), trees.Growth(**({"trees": 10, "least": 5} | k)))
    assert all((t.feature >= 0).sum() == 1 for t in fit(leaves=2).trees)
    assert all((t.feature >= 0).sum() <= 6 for t in fit(leaves=7).trees) and any((t.feature >= 0).sum() == 6 for t in fit(leaves=7).trees)
    error = [np.mean((fit(l2=v).predict(x) - y) ** 2) for v in (0, 50, 500)]
    assert error == sorted(error) and error[0] < error[2]
    assert not fit(l1=1e9).trees
    assert all(len(set(t.feature[t.feature >= 0])) == 1 for t in fit(columns=0.34).trees)
    assert np.array_equal(fit(rows=0.5).predict(x), fit(rows=0.5).predict(x)) and not np.array_equal(fit(rows=0.5).predict(x), fit().predict(x))


@pytest.fixture(scope="module")
def rows(spark):
    x, y = planted(900)
    x[::7, 0], x[3::11, 2] = np.nan, np.nan
    w = np.random.default_rng(2).integers(0, 4, len(y)).astype(float)
    table = [([None if np.isnan(v) else float(v) for v in r], float(a), float(b)) for r, a, b in zip(x, y, w)]
    return spark.createDataFrame(table, "x array<double>, y double, w double").repartition(5), x, y, w


def test_histograms_over_executors_grow_the_same_trees(rows, monkeypatch):
    df, x, y, w = rows
    monkeypatch.setattr(pooled, "BLOCK", 100)
    monkeypatch.setattr(pooled, "CUT", 3)
    g = trees.Growth(trees=8, rate=0.2, leaves=9, depth=4, least=10, l1=1.0, l2=2.0, columns=0.7)
    far = pooled.fit_blocks(df, 3, g, trees.edges_of(x))
    near = trees.fit_arrays(x, y, w, g)
    assert len(far.trees) == 8 and np.allclose(far.predict(x), near.predict(x))
    assert [t.feature.tolist() for t in far.trees] == [t.feature.tolist() for t in near.trees]
    found = pooled.feature_edges(df, 3)
    assert all(np.isin(e, trees.edges_of(x)[f]).all() and len(e) > 0.5 * len(trees.edges_of(x)[f]) for f, e in enumerate(found))
    part = pooled.fit_blocks(df, 3, trees.Growth(trees=4, least=10, rows=0.5))
    assert len(part.trees) == 4


def test_large_groups_use_histograms_over_executors(rows, monkeypatch):
    df, _, y, _ = rows
    df = df.select(*[F.get("x", F.lit(i)).alias(f"feature_{i}") for i in range(3)], "y", F.when(F.rand(3) < 0.8, "train").otherwise("test").alias("sample")).checkpoint()
    params = {"maxIter": 6, "num_leaves": 7, "minInstancesPerNode": 10, "reg_lambda": 1.0, "stepSize": 0.3}
    features = [f"feature_{i}" for i in range(3)]
    near = models.fit_predict(df, features, "y", "LGBM", params)
    monkeypatch.setattr(models, "MOST", 10)
    far = models.fit_predict(df, features, "y", "LGBM", params)
    assert far.model is not None and near.model is None and far.params == near.params == params
    a, b = (np.array([r.prediction for r in f.frame.orderBy("y").collect()]) for f in (near, far))
    assert np.allclose(a, b)
    assert far.importances[0][0] == near.importances[0][0] == "feature_0"


@pytest.mark.parametrize("params", [{"regParam": 0.0}, {"regParam": 0.5, "elasticNetParam": 0.0}, {"regParam": 0.5, "elasticNetParam": 0.5}, {"regParam": 0.3, "elasticNetParam": 1.0}])
def test_lines_equal_those_of_mllib(spark, params):
    x, y = planted(200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    df = models.VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    far = models.LinearRegression(labelCol="y", tol=1e-12, maxIter=500, **params).fit(df)
    near = fits.fit("LR", x, y, np.ones(200), params)
    assert np.allclose(near.slopes, far.coefficients.toArray(), atol=1e-4) and abs(near.intercept - far.intercept) < 1e-3


def test_forests_and_adaptive_trees_learn():
    x, y = planted(400)
    for model, params in (("RF", {"numTrees": 20, "maxDepth": 8}), ("ADA", {"maxIter": 20, "maxDepth": 4}), ("GBM", {"maxIter": 60})):
        fitted = fits.fit(model, x[:300], y[:300], np.ones(300), params)
        assert np.mean((fitted.predict(x[300:]) - y[300:]) ** 2) < 0.15 * np.var(y[300:]), model
        assert fitted.importances.argmax() == 0
    steady = fits.fit("ADA", x, np.full(400, 3.0), np.ones(400), {})
    assert np.allclose(steady.predict(x), 3.0)


# many models in one job


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    table = []
    for c in range(3):
        for g in range(20):
            for i in range(24):
                f = float(rng.integers(0, 9))
                table.append((datetime.date(2024, 1 + c, 1), g if g else None, f"k{g}", datetime.date(2023, 1, 1) + datetime.timedelta(i), "train" if i < 18 else "test", f * (g + 1) + c, f, None if i % 5 == 0 else float(i)))
    return spark.createDataFrame(table, "cutoff date, grp int, k string, date date, sample string, y double, feature_f double, feature_i double").repartition(6).checkpoint()


@pytest.mark.parametrize("model,params", [("LGBM", None), ("LR", None), ("GBM", {"maxIter": 5, "maxDepth": 2}), ("RF", {"numTrees": 5}), ("ADA", {"maxIter": 4})])
def test_many_models_in_one_job_equal_those_fitted_one_by_one(spark, panel, model, params):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"many-{model}", "")
    out = models.run_backtesting(panel, "k", ["feature_f", "feature_i"], "y", "grp", model, params)
    out.frame.count()
    used = len(jobs.getJobIdsForGroup(f"many-{model}"))
    spark.sparkContext.setJobGroup("", "")
    assert len(out.fitted) == 60 and used < 30  # not some for each of the 60 models
    whole = {(r.cutoff, r.grp, r.date): r.prediction for r in out.frame.collect()}
    assert len(whole) == 60 * 24 and min(whole.values()) >= 0
    for c, g in ((datetime.date(2024, 1, 1), 5), (datetime.date(2024, 3, 1), None)):
        one = models.fit_predict(panel.where((F.col("cutoff") == F.lit(c)) & F.col("grp").eqNullSafe(F.lit(g))), ["feature_f", "feature_i"], "y", model, params)
        assert all(abs(whole[r.cutoff, r.grp, r.date] - r.prediction) < 1e-9 for r in one.frame.collect())
        assert out.fitted[c, g].params == one.params and out.fitted[c, g].importances == one.importances
        assert out.fitted[c, g].frame.count() == 24


def test_each_group_gets_its_own_features_and_parameters(panel):
    sampled = panel.withColumn("half", F.when(F.col("grp") < 10, 1).otherwise(2))
    sampled = sampled.withColumn("y", F.when(F.col("half") == 1, F.col("feature_f")).otherwise(F.coalesce("feature_i", F.lit(0.0))))
    out = models.run_backtesting(sampled, "k", ["feature_f", "feature_i"], "y", "half", "LR", best_features=True, n_best_features=1)
    assert {(g, f.importances[0][0]) for (_, g), f in out.fitted.items()} == {(1, "feature_f"), (2, "feature_i")}
    alone = models.run_backtesting(panel, "k", ["feature_i", "feature_f"], "y", "grp", "LR", best_features=True, n_best_features=1)
    assert {tuple(n for n, _ in f.importances) for f in alone.fitted.values()} == {("feature_i",)}  # a quarter of one series is none


def test_halving_grows_rows_and_counts_its_fits(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (4000, 2)).astype(float)
    y = 10 * (x[:, 0] > 2) + 100 * (x[:, 1] % 2)  # one split cannot tell it
    day = datetime.date(2015, 1, 1)
    df = spark.createDataFrame([(day + datetime.timedelta(i // 2), float(a), float(b), float(v), "train") for i, ((a, b), v) in enumerate(zip(x, y))], "date date, a double, b double, y double, sample string")
    rows = tuning.rows_for(df, F.when(F.col("date") < datetime.date(2019, 1, 1), "old").otherwise("new"), ["a", "b"], F.col("y"), F.lit(1.0), "date", 1)
    sizes = {r.name: r["count"] for r in rows.groupBy("name").count().collect()}
    space = {"maxIter": [20], "stepSize": [0.3], "maxDepth": [1, 2, 5], "num_leaves": [2, 3, 15], "minInstancesPerNode": [1, 400, 3000]}
    found = [tuning.search(rows, sizes, "LGBM", space, scoring="neg_mean_squared_error") for _ in range(2)]
    assert found[0] == found[1]
    assert all(p["maxDepth"] == 5 and p["num_leaves"] == 15 and p["minInstancesPerNode"] < 3000 for p in found[0].best.values())
    first = max(sizes.values()) // 27
    assert [b[0] for b in found[0].brackets] == [first, 3 * first, 9 * first]
    assert found[0].brackets[0][1:] == (27, 27 * 4) and found[0].brackets[1][1:] == (9, 36)
    whole = tuning.search(rows, sizes, "LGBM", {**space, "minInstancesPerNode": [1]}, "grid", scoring="neg_mean_squared_error")
    assert whole.brackets == [(max(sizes.values()), 9, 36)] and all(p["maxDepth"] == 5 for p in whole.best.values())


def test_halving_reaches_its_resources(spark):
    x, y = planted(3500)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, a double, b double, c double, y double")
    rows = tuning.rows_for(df, F.lit("n"), ["a", "b", "c"], F.col("y"), F.lit(1.0), None, 1)
    found = tuning.search(rows, {"n": 3500}, "LR", {"regParam": [i / 10 for i in range(400)]}, scoring="neg_mean_squared_error")
    assert found.brackets == [(8, 375, 1500), (24, 125, 500), (72, 42, 168), (216, 14, 56), (648, 5, 20), (1944, 2, 8)]
    assert found.best["n"]["regParam"] < 5


def test_folds_expand():
    assert [tuning.fold(13, k, 4) for k in range(4)] == [(5, 7), (7, 9), (9, 11), (11, 13)]
    assert all(a <= 0 or a >= b for a, b in (tuning.fold(1, k, 4) for k in range(3)))


def test_tuning_a_backtest_is_one_search(panel):
    space = {"regParam": [0.0, 1e4]}
    out = models.run_backtesting(panel, "k", ["feature_f", "feature_i"], "y", "grp", "LR", tune_hyperparameters=True, param_distributions=space, scoring="neg_mean_squared_error")
    assert len(out.fitted) == 60 and sum(f.params == {"regParam": 0.0} for f in out.fitted.values()) > 50


# columns that are not ours


def test_baselines_leave_other_columns_as_they_are(spark):
    big = 9007199254740993
    schema = "k string, n int, date date, sample string, y double, f double, big long, amount decimal(30,10), at timestamp, deep struct<a:long,b:array<decimal(20,2)>>, raw binary, flag boolean"
    rows = []
    for i in range(60):
        void = i % 3 == 0
        rows.append((f"s{i % 4}" if i % 4 else None, i % 2, datetime.date(2024, 1, 1) + datetime.timedelta(i // 4), "train" if i < 44 else "test", None if i >= 44 else float(i), float(i % 5),
                     None if void else big + i, None if void else __import__("decimal").Decimal("12345678901234567890.0123456789"), None if void else datetime.datetime(2024, 1, 1, 3, 4, 5, i), None if void else (big, [None]), None if void else bytes([i]), None if void else bool(i % 2)))
    df = spark.createDataFrame(rows, schema).repartition(3)
    want = sorted(map(repr, df.collect()))
    for out in (
        baselines.croston_baseline(df, ["k"], "date", ["y", "f"]),
        baselines.boosted_baseline(df, ["k"], "date", ["y"], ["f", "n"], trees=3),
        models.fit_groups(df, ["k"], ["f"], "y", "LR"),
    ):
        assert out.schema.fields[: len(df.columns)] == df.schema.fields
        assert sorted(map(repr, out.select(*df.columns).collect())) == want


def test_long_groups_are_cut_once():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": pa.array(ks, pa.float64())}) for ks in ([None] * 3, [None, 1.0], [1.0] * 4, [], [1.0, 2.0, 2.0], [3.0])]
    lots = list(groups.whole_groups(iter(batches), [0], 2))
    assert [sum(b.num_rows for b in lot) for lot, _ in lots] == [4, 6, 2, 1][: len(lots)] or sum(len(n) for _, n in lots) == 13
    seen = [k for lot, _ in lots for b in lot for k in b.column(0).to_pylist()]
    assert seen == [None] * 4 + [1.0] * 6 + [2.0] * 2 + [3.0]
    for lot, number in lots:
        ks = [k for b in lot for k in b.column(0).to_pylist()]
        assert [ks[i] != ks[i - 1] for i in range(1, len(ks))] == (np.diff(number) == 1).tolist() and number[0] == 0
    ends = [[b.column(0).to_pylist() for b in lot][-1][-1] for lot, _ in lots]
    assert len(ends) == len(set(map(str, ends)))  # no key in two lots


def test_keys_are_sampled_exactly(spark):
    df = spark.createDataFrame([(f"g{i % 3}", i // 3, j) for i in range(300) for j in range(2)], "g string, k int, j int")
    once, again = (sorted(map(tuple, columns.sample_keys(d, ["g", "k"], 0.25, 5).collect())) for d in (df, df.repartition(7)))
    assert once == again and len(once) == 75
    by = columns.sample_keys(df, ["g", "k"], 0.1, 5, ["g"]).groupBy("g").count().collect()
    assert {r["count"] for r in by} == {10} and len(by) == 3
    assert columns.sample_keys(df.where("false"), ["k"], 0.5).count() == 0


def test_mutual_information_of_ties_equals_all_pairs():
    rng = np.random.default_rng(3)
    for x, y in ((rng.integers(0, 12, 900) * 0.1, rng.normal(size=900)), (rng.normal(size=700), rng.integers(0, 3, 700) / 7), (rng.integers(0, 5, 400) / 3, rng.integers(0, 4, 400) / 3), (np.ones(50), rng.normal(size=50))):
        n, k = len(x), 3
        a, b = ((v - v.mean()) / (v.std() or 1.0) for v in (x.astype(float), y.astype(float)))
        dx, dy = np.abs(a[:, None] - a), np.abs(b[:, None] - b)
        both = np.maximum(dx, dy)
        np.fill_diagonal(both, np.inf)
        r = np.partition(both, k - 1, axis=1)[:, k - 1][:, None]
        psi = lambda m: np.r_[0, np.cumsum(1 / np.arange(1, n + 1))][np.maximum(m, 1) - 1] - 0.5772156649015329  # noqa: B023, E731
        want = psi(np.array([n]))[0] + psi(np.array([k]))[0] - (psi((dx < r).sum(1)) + psi((dy < r).sum(1))).mean()
        assert abs(models.mutual_information(x.astype(float), y.astype(float)) - max(0.0, want)) < 1e-9


def test_a_fit_tells_what_it_did(panel):
    told = models.fit_groups(panel, ["cutoff", "grp"], ["feature_f"], "y", "LGBM").where("_fit IS NOT NULL").select("_fit").collect()
    assert len(told) == 60 and json.loads(told[0][0])["params"] == models.heuristic_params("LGBM", 18, 1)


def test_default_parameters_beat_the_moving_average(spark):
    """A yearly shape and a calendar effect that a moving average cannot see, on held-out weeks."""
    rng = np.random.default_rng(4)
    first, table = datetime.date(2020, 1, 6), []
    for k in range(12):
        for i in range(160):
            day = first + datetime.timedelta(weeks=i)
            week = day.isocalendar()[1]
            table.append((f"k{k}", day, datetime.date(2022, 10, 3), "train" if day < datetime.date(2022, 10, 3) else "test", float(20 + 3 * k + 15 * np.sin(week / 52 * 2 * np.pi) + rng.normal()), float(week), float(k), float(i)))
    df = spark.createDataFrame(table, "k string, date date, cutoff date, sample string, y double, feature_week double, feature_k double, feature_i double")
    df = baselines.ma_baseline(df.withColumn("seen", F.when(F.col("sample") == "train", F.col("y"))), ["k", "cutoff"], "date", ["seen"], 13)
    out = models.run_backtesting(df, "k", ["feature_week", "feature_k", "feature_i"], "y")
    (fitted,) = out.fitted.values()
    assert fitted.params["maxIter"] == 500 and fitted.params["num_leaves"] == 32
    error = out.frame.where("sample = 'test'").agg(F.avg(F.abs(F.col("prediction") - F.col("y"))).alias("model"), F.avg(F.abs(F.col("baseline_seen_ma_13") - F.col("y"))).alias("ma")).first()
    assert error.model < 0.5 * error.ma, error
