from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from seriesloom.llm import ann

SCHEMA = "vec_id long, embedding array<double>"


def found(spark, rows, **options):
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in rows], SCHEMA), **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    return got


def by_brute_force(x, ids, q, k=10):
    """The ``k`` nearest ids (ascending distance, then id) of the vector with id ``q``."""
    d = {}
    for i, v in zip(ids, x):
        if i != q:
            d[i] = min(d.get(i, np.inf), float(np.sqrt(((v - x[ids.index(q)]) ** 2).sum())))
    return sorted(((s, i) for i, s in d.items()))[:k]


@pytest.mark.parametrize("n", [1, 2, 6, 10, 11, 12, 40])
def test_few_candidates_are_all_found(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    got = found(spark, list(enumerate(x)))
    want = by_brute_force(x, list(range(n)), 0, 10 if n < 12 else 3)  # beyond 11 rows not all need be met
    assert len(got[0]) == min(10, n - 1)
    if n < 12:
        assert [i for i, _ in got[0]] == [i for _, i in want]
    assert [s for _, s in got[0]][: len(want)] == pytest.approx([s for s, _ in want])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_of_unrelated_vectors(spark, kind):
    """Nothing is harder to hash than vectors without any structure; blocks of all sizes, clashing columns."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(5200, 64)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    df = df.selectExpr("*", *[f"1 AS {c}" for c in ("id", "v", "dim", "t", "b", "q", "own", "looks", "rank", "score", "query_id")])
    got = defaultdict(list)
    for r in ann.nearest(df, every=400, block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    assert set(got) == set(range(0, 5200, 400))
    hits = 0
    for q, own in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [s for _, s in own] == [d[i] for i, _ in own] and len(own) == 10
        d[q] = np.inf
        hits += len({i for i, _ in own} & set(np.argsort(d)[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_buckets_grow_with_the_rows():
    count = lambda n, dim=64: np.prod([2 * w for w in ann.hash_widths(dim, n)])
    assert [int(count(n)) for n in (1, 5_000, 50_000, 10**7, 10**9)] == [128, 1024, 2048, 8192, 32768]
    assert count(10**9, 8) >= 16384 and ann.hash_widths(2000, 100) == [2048]


def test_repeated_ids_take_one_place(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=64)
    near = [(7, x + 1e-3 * (j + 1)) for j in range(12)]  # one id, twelve vectors, all in the query's buckets
    copies = [(7, near[0][1])] * 5
    equal = [(20 + j, x + 1e-1) for j in range(30)]
    got = found(spark, [(0, x), *near, *copies, *equal], block=4096)
    assert [i for i, _ in got[0]] == [7, *range(20, 29)]
    assert got[0][0][1] == pytest.approx(8e-3)


def test_batches_without_queries(spark):
    x = np.random.default_rng(2).normal(size=(150, 16))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = found(spark, [(i + 1, v) for i, v in enumerate(x)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {100} and len(got[100]) == 10
