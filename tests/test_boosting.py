from __future__ import annotations

import datetime

import numpy as np
import pytest

from seriesloom.operators import baselines, groups
from seriesloom.operators.boosting import bin_edges, boosted_series


def boosted_alone(x, y, ask, trees, rate, leaves=31, least=20):
    """One series in the plainest way: every leaf is searched for its best split, the best of all is taken."""
    start = y.mean()
    rest, out = y - start, np.full(len(ask), start)

    def best(own):
        found = (0.0, 0, 0.0)
        for f in range(x.shape[1]):
            for edge in np.unique(x[own, f])[:-1]:
                low = x[own, f] <= edge
                k, m = low.sum(), len(own)
                if min(k, m - k) >= least:
                    part, total = rest[own][low].sum(), rest[own].sum()
                    gain = part**2 / k + (total - part) ** 2 / (m - k) - total**2 / m
                    found = max(found, (gain, f, edge), key=lambda g: g[0])
        return found

    for _ in range(trees):
        grown = [(best(np.arange(len(y))), np.arange(len(y)), np.arange(len(ask)))]
        while len(grown) < leaves:
            j = max(range(len(grown)), key=lambda j: grown[j][0][0])
            (gain, f, edge), own, asked = grown[j]
            if gain <= 1e-12:
                break
            sides = [(own[s], asked[a]) for s, a in ((x[own, f] <= edge, ask[asked, f] <= edge), (x[own, f] > edge, ask[asked, f] > edge))]
            grown[j : j + 1] = [(best(o), o, a) for o, a in sides]
        if len(grown) == 1:
            break
        for _, own, asked in grown:
            step = rate * rest[own].mean()
            rest[own] -= step
            out[asked] += step
    return out


@pytest.mark.parametrize("leaves", [31, 4, 2])
def test_series_grown_together_equal_series_grown_alone(leaves):
    rng = np.random.default_rng(leaves)
    sizes, x, y, ask = [1, 12, 30, 47, 80, 80, 140], [], [], []
    for n in sizes:
        x.append(np.c_[rng.integers(0, 25, n), rng.integers(0, 3, n)].astype(float))
        y.append(2 * x[-1][:, 0] + 9 * (x[-1][:, 1] > 1) + rng.normal(0, 3, n))
        ask.append(np.c_[rng.integers(-3, 30, 6), rng.integers(0, 4, 6)].astype(float))
    number = np.repeat(np.arange(len(sizes)), sizes)
    want = np.concatenate([boosted_alone(a, b.copy(), c, 12, 0.1, leaves, 8) for a, b, c in zip(x, y, ask)])
    order = rng.permutation(len(number))
    got = boosted_series(np.concatenate(x)[order], np.concatenate(y)[order], number[order], np.concatenate(ask), np.repeat(np.arange(len(sizes)), 6), len(sizes), 12, 0.1, leaves, 8)
    assert np.allclose(got, want)


def test_many_values_share_bins():
    edges = bin_edges(np.arange(10_000.0))
    assert len(edges) == 255 and edges[-1] == 9999


def test_series_may_span_batches_and_lots(spark, monkeypatch):
    rows, first = [], datetime.date(2024, 1, 1)
    for key in ("a", "b", None, "only tests", "one row"):
        for i in range(90):
            train = key != "only tests" and (i < 80 if key != "one row" else i == 0)
            rows.append((key, "c", first + datetime.timedelta(i), "train" if train else "test", None if i == 3 else float(i % 4), float(i % 4), None if i % 2 else 1.0))
    df = spark.createDataFrame(rows, "k string, cutoff string, date date, sample string, y double, f double, g double").repartition(4)
    make = lambda: {(r.k, r.date): r.baseline_y_lgbm for r in baselines.boosted_baseline(df, ["k"], "date", ["y"], ["f", "g"], trees=80).collect()}
    whole = make()
    assert len(whole) == len(rows)
    for (k, d), v in whole.items():
        i = (d - first).days
        if k in ("a", "b", None):
            assert v == (None if i == 3 else float(i % 4)) if i < 80 else abs(v - i % 4) < 0.5
        else:
            assert (v is None) == ((k, i) != ("one row", 0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(groups, "TOGETHER", 50)
    try:
        assert make() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
