from __future__ import annotations

import random
from collections import Counter

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import mixing, near_copies, simhash

SCHEMA = "doc_id long, text string"


def shingles(text, n=5):
    w = brute.words((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)} - {()}


def similar(a, b):
    return a == b or len(a & b) * 5 >= len(a | b) * 4 > 0


def groups(texts):
    """Index of the smallest member reachable over pairs of similarity 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited(words, rng, vocabulary, most):
    w = list(words)
    for _ in range(rng.randint(1, most)):
        w[rng.randrange(len(w))] = rng.choice(vocabulary) + "q"
    return " ".join(w)


@pytest.fixture(scope="module")
def edits(prose, vocabulary):
    """Families around the threshold: most pairs differ in far more than two fingerprint bits."""
    rng = random.Random(3)
    out = []
    for k in range(25):
        base = prose(1000 + k, 60 + 20 * k).split()
        out += [" ".join(base), *(edited(base, rng, vocabulary, len(base) // 25) for _ in range(3))]
    return out


def test_all_similar_texts_leave_one(spark, edits):
    texts = [*edits, None, "", "a b", "A  b", "a c"]
    want = set(groups(texts))
    prints = [brute.fingerprint(t) for t in texts]
    assert len(want) < len(set(brute.components(prints))) - 10
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert Counter(r.doc_id for r in simhash.keep_one(df).collect()) == Counter(want)


def test_large_buckets_lose_no_link(spark, prose, vocabulary, monkeypatch):
    rng = random.Random(5)
    base = prose(2000, 100).split()
    texts = [edited(base, rng, vocabulary, 4) for _ in range(80)]
    want = groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for bucket, block in ((16, 256), (2, 5)):  # as pairs, and in blocks
        monkeypatch.setattr(near_copies, "BUCKET", bucket)
        monkeypatch.setattr(near_copies, "BLOCK", block)
        rows = near_copies.near_copies(df).groupBy("component").agg(F.min("id").alias("id")).collect()
        assert sorted(r.id for r in rows) == sorted(set(want))


def test_texts_whose_fingerprints_link_leave_one(spark, prose):
    """Texts of which under 0.8 of the shingles are shared, but whose fingerprints are at most 2 bits apart, and what else either side links."""
    phrase = prose(4000, 25)
    copies = [" ".join([phrase] * 30 + [prose(4001 + k, 45)]) for k in range(3)]  # the repeated phrase has nearly all votes
    edge = copies[0].rsplit(" ", 4)[0]  # a near copy by shingles
    texts = [*copies, edge, prose(4100, 60), None, "", "a b", "a c"]
    prints, sets = [brute.fingerprint(t) for t in texts], [shingles(t) for t in texts]
    near = [[(prints[i] ^ prints[j]).bit_count() <= 2 for j in range(len(texts))] for i in range(len(texts))]
    assert near[0][1] and near[0][2] and not similar(sets[0], sets[1]) and not similar(sets[0], sets[2])
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (near[i][j] or similar(sets[i], sets[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(root))
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "simhash near-dedup"


def test_rows_are_kept_by_content_not_by_id(spark, prose):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (1, b), (None, a), (None, c), (None, c + " x"), (2, b), (3, c), (3, c), (4, None), (None, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, a), (1, b), (3, c), (4, None)])
    unnamed = [(None, a), (None, b), (None, b + " x"), (None, b)]
    kept = simhash.keep_one(spark.createDataFrame(unnamed, SCHEMA)).collect()
    assert len(kept) == 2 and {(r.text or "")[:20] for r in kept} == {a[:20], b[:20]}


def test_mixed_rows_need_no_id_of_their_own(spark, prose):
    texts = {k: prose(k, 30 + 5 * k) for k in range(12)}
    rows = [(None if k < 4 else k // 3, texts[k], "one") for k in range(12)] + [(None, texts[0], "one"), (7, texts[5], "two"), (8, "", "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    took = Counter()
    for r in mixing.mix(docs, row=mixing.row_key(docs)).collect():
        if r.size:
            took[r.row] += int(r.taken / r.size + 0.5)
    # the one source has all rows but two, the other at most three times its size
    got = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(docs).collect())
    keys = {r.row: (r.doc_id, r.text) for r in docs.select("doc_id", "text", mixing.row_key(docs).alias("row")).collect()}
    assert got == Counter({keys[k]: n for k, n in took.items() if n})
    words = sum(len(brute.words(t)) * n for (_, t), n in got.items())
    assert abs(words - sum(len(brute.words(t)) for _, t, _ in rows)) <= max(map(len, map(brute.words, texts.values())))
    assert any(i is None for i, _ in got) and len({t for i, t in got if i == 1}) > 1
