from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import exact_dedup, fill_in_middle, hard_negatives

# 11

VECTORS = "vec_id long, label int, embedding array<float>"


def negatives_by_brute_force(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    rows = [(i, y, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, q in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * z for x, z in zip(q, v)), i, y) for i, y, v in rows if i != a and len(v) == len(q))
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            found = [(i, -t) for t, i, y in scored if y != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(found[:negatives])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(4)), (centers[rng.integers(6)] + 0.2 * rng.normal(size=8)).astype("float32").tolist()) for i in range(1200)]
    same = rows[17][2]
    return rows + [(5000 + i, int(rng.integers(4)), same) for i in range(500)] + [(7000 + i, 1, same) for i in range(300)]


@pytest.mark.parametrize("tree", [1 << 14, 150])
def test_hard_negatives_equal_brute_force(spark, clustered, monkeypatch, tree):
    monkeypatch.setattr(hard_negatives, "SHARE", 100)
    monkeypatch.setattr(hard_negatives, "TREE", tree)
    monkeypatch.setattr(hard_negatives, "HELD", 20)  # several blocks of anchors
    df = spark.createDataFrame(clustered, VECTORS).repartition(5)
    want = negatives_by_brute_force(clustered)
    assert len(want) > 100 and found(hard_negatives.hard_negatives(df)) == want


def test_hard_negatives_leave_odd_rows_out(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(160)]
    rows += [(200, 1, None), (250, None, [1.0] * 4), (None, 1, [1.0] * 4), (300, 1, [1.0, None, 1.0, 1.0]), (350, 1, [float("nan")] * 4), (400, 2, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(450, 0, [0.0] * 4), (500, 1, []), (501, 1, []), (502, 2, []), (550, 1, [1.0, 2.0]), (551, 1, [1.5, 2.0]), (552, 2, [0.9, 1.0]), (-50, 0, [2.0, -1.0, 0.5, 0.0])]
    df = spark.createDataFrame(rows, VECTORS)
    want = negatives_by_brute_force(rows)
    assert {450, 550, -50} & {r[0] for r in want}
    twice = df.unionByName(df).selectExpr("*", "1 AS id", "2 AS row", "3 AS cell", "4 AS score", "5 AS w", "6 AS dim")
    assert found(hard_negatives.hard_negatives(df)) == found(hard_negatives.hard_negatives(twice)) == want
    assert found(hard_negatives.hard_negatives(df.where("false"))) == []
    assert found(hard_negatives.hard_negatives(df.where("vec_id = 50"))) == []


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(0, 1, [2.0, 0.0]), (3, 1, [1.5, 0.0]), (3, 1, [1.0, 0.0]), (4, 2, [1.0, 0.5]), (4, 2, [1.1, 0.5]), (0, 2, [1.2, 0.0])]
    want = negatives_by_brute_force(rows)
    assert len(want) == 3 and found(hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS))) == want


def test_scores_beyond_doubles_are_whole(spark):
    rows = [(0, 1, [300_001.5, 400_000.25]), (1, 1, [300_000.75, 390_000.5]), (2, 2, [200_000.5, 300_000.5]), (3, 2, [200_000.5, 300_000.53125])]
    assert (256 * 500_000) ** 2 > hard_negatives.EXACT
    got = found(hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)))
    assert got == negatives_by_brute_force(rows) and [r[3] for r in got] == [3, 2]


def test_trees_leave_nodes_out(clustered):
    v = np.floor(256 * np.array([r[2] for r in clustered]))
    ids, labels = np.array([r[0] for r in clustered]), np.array([r[1] for r in clustered])
    own = np.flatnonzero(ids % 50 == 0)
    wide = [np.full((len(own), 1), x) for x in (-hard_negatives.LAST, hard_negatives.LAST)]
    free = hard_negatives.Search(v[own], labels[own], ids[own], *wide, 3, True)
    free.tree(v, ids, labels)
    same = (labels[own][:, None] == labels).sum()
    assert free.compared < 0.75 * same, (free.compared, same)
    top = free.scores[:, 0, :1].astype(np.int64)
    narrow = hard_negatives.Search(v[own], labels[own], ids[own], top // 10, top // 9, 3, False)
    narrow.tree(v, ids, labels)
    assert narrow.compared < 0.75 * (len(own) * len(ids) - same), narrow.compared


def test_balls_are_smaller_than_around_the_mean():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(4, 4)) + 40])  # the mean lies with the many
    (root, order), wide = hard_negatives.ball_tree(x, np.arange(64)), np.linalg.norm(x - x.mean(0), axis=1).max()
    assert np.linalg.norm(x - root.center, axis=1).max() <= root.radius < 0.7 * wide
    for rows in (x, np.repeat(x[:1], 200, 0)):  # no row is lost, none lies outside, equal rows included
        (root, order), stack = hard_negatives.ball_tree(rows, np.arange(len(rows)), 8), []
        stack.append(root)
        while stack:
            node = stack.pop()
            assert np.linalg.norm(rows[order[node.low : node.high]] - node.center, axis=1).max() <= node.radius + 1e-9
            stack += [node.left, node.right] if node.left else []
        assert sorted(order) == list(range(len(rows)))


# 12


def middle_by_brute_force(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<P>|<S>|<M>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_brute_force(documents, clashing, hard_texts):
    want = {i: middle_by_brute_force(i, t) for i, t in enumerate(hard_texts)}
    assert {w[1] for w in want.values()} == {"plain", "psm", "spm"}
    for df in (documents, clashing):
        assert {r.id: tuple(r)[1:] for r in fill_in_middle.fill_in_middle(df).collect()} == want
        got = {r.doc_id: r for r in fill_in_middle.op12_fill_in_middle(df).collect()}
        for i, t in enumerate(hard_texts):
            assert got[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
            assert got[i].output_sha256 == hashlib.sha256(want[i][4].encode()).hexdigest()


def test_fill_in_middle_with_marks_in_pieces(spark, empty):
    texts = ["".join(x) for n in range(5) for x in itertools.product(["<", "P>", "S", ">", "<<", "M>", "a"], repeat=n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fill_in_middle.fill_in_middle(df).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) and all(r.back == texts[r.id] for r in rows)
    assert {r.form for r in rows if re.search("<P>|<S>|<M>", texts[r.id])} == {"plain"}
    assert fill_in_middle.op12_fill_in_middle(empty).count() == 0


def test_fill_in_middle_of_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "some words, here"), (4, "x y z"), (4, "x y z"), (4, None)], "doc_id long, text string")
    rows = fill_in_middle.fill_in_middle(df).collect()
    assert sorted((str(r.id), r.output) for r in rows) == sorted((str(i), middle_by_brute_force(i, t)[4]) for i, t in [(None, "some words, here"), (4, "x y z"), (4, "x y z"), (4, None)])
    always = fill_in_middle.fill_in_middle(df, rearranged=100, suffix_first=100)
    assert {r.form for r in always.where("output <> ''").collect()} == {"spm"}


# 13


def exact_by_brute_force(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left > 0, hashlib.sha256(t.encode()).hexdigest()))
            left -= i == keep
    return sorted(out, key=repr)


def got13(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits,capacity,listed", [(64, 4096, 100_000), (64, 3, 0), (3, 2, 1000), (1, 1, 0)])
def test_exact_dedup_equals_brute_force(documents, hard_texts, bits, capacity, listed):
    """Few bits make different texts share keys, a small capacity splits buckets, and no listing joins by shuffles."""
    assert got13(exact_dedup.duplicates(documents, bits=bits, capacity=capacity, listed=listed)) == exact_by_brute_force(list(enumerate(hard_texts)))


def test_exact_dedup_of_odd_rows(spark, documents, clashing, empty):
    assert got13(exact_dedup.op13_exact_dedup(documents)) == got13(exact_dedup.op13_exact_dedup(clashing))
    assert exact_dedup.op13_exact_dedup(empty).count() == 0
    rows = [(None, "a"), (None, "a"), (1, None), (2, ""), (3, "b"), (3, "b"), (3, "c"), (5, "b "), (6, "B"), (None, "b"), (9, "é"), (10, "é"), *[(100 + i, "hot") for i in range(500)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got13(exact_dedup.duplicates(df)) == got13(exact_dedup.duplicates(df, bits=2, capacity=1)) == exact_by_brute_force(rows)


def test_keep_distinct_leaves_one_row_of_each_text(documents, hard_texts):
    want = {max(i for i, t in enumerate(hard_texts) if (t or "") == x) for x in {t or "" for t in hard_texts}}
    out = exact_dedup.keep_distinct(documents)
    assert out.columns == documents.columns and {r.doc_id for r in out.collect()} == want


def test_directory_doubles_until_buckets_fit(spark):
    rng = random.Random(2)
    crowded = [rng.getrandbits(57) for _ in range(300)]  # one corner of the keys
    keys = sorted({*crowded, *[rng.getrandbits(64) - (1 << 63) for _ in range(100)]})
    slots, depth = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "key long"), capacity=40)
    rows = slots.collect()
    assert depth > 8 and all(r.n <= 40 for r in rows)
    buckets = {(r.bucket, r.depth): r.n for r in rows}
    assert sum(buckets.values()) == len(keys) and len({d for _, d in buckets}) > 2
    for r in rows:
        assert r.slot >> (depth - r.depth) == r.bucket >> (depth - r.depth)
